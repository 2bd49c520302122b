"""Published examples of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from tablemill.functions import arrays, dates, html, names, numbers
from tablemill.functions import text as tx
from tablemill.operators import sets, summary


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first().v


def test_text(value):
    s = F.lit
    assert value(tx.truncate(s("Hello World"), 6)) == "Hel..."
    assert value(tx.truncate(s("Problem solving is the best!"), 10)) == "Problem..."
    assert value(tx.truncate(s("Yo"), 100)) == "Yo"
    assert value(tx.truncate(s("Woah"), 4)) == "W..." and value(tx.truncate(s("Woah"), 3)) == "..."
    assert value(tx.truncate(s("Cool"), 1)).startswith("Tuncation")
    assert value(tx.letter_count(s("Hello World"), "h")) == 1 and value(tx.letter_count(s("Hello World"), "z")) == 0
    assert value(tx.char_counts(s("yay"))) == {"y": 2, "a": 1} and value(tx.char_counts(s("Yay"))) == {"Y": 1, "a": 1, "y": 1}
    assert value(tx.vowel_counts(s("HOW ARE YOU? i am great!"))) == {"o": 2, "a": 3, "e": 2, "u": 1, "i": 1}
    assert value(tx.capitalize_first(s("only first word capitalized"))) == "Only first word capitalized"
    assert value(tx.money_text(s(-123456.789).cast("double"))) == "$-123,456.79"
    assert value(tx.money_text(s(1.0), 10)) == "$      1.00" and value(tx.money_text(s(3.0), 0, "")) == "3.00"
    assert float(value(tx.parse_money(s("$2,629.13 ")))) == 2629.13 and value(tx.parse_money(s("none"))) is None
    assert value(tx.mask_account(s("1234-5678"))) == "12345***" and value(tx.mask_account(s("123"))) is None
    assert value(tx.normal_name(s("Bob Q Smith"))) == "bob_q_smith"
    assert value(tx.strong_password(s("Abcdefghi1"))) and not value(tx.strong_password(s("abcdefghi1"))) and not value(tx.strong_password(s("Abc1")))
    assert value(tx.number_after_colon(s("X-Confidence: 0.8475"))) == 0.8475
    assert value(tx.skip_repeats(tx.words(s("this this this is a sample this sample")))) == ["this", "is", "a", "sample", "this", "sample"]


def test_word_count_ignores_repeats(spark):
    df = spark.createDataFrame([("this this this is a sample this sample",)], "t string")
    got = {r.word: r.n for r in summary.word_counts(df, tx.skip_repeats(tx.words(F.col("t")))).collect()}
    assert got == {"this": 2, "is": 1, "a": 1, "sample": 2}


def test_names():
    assert [names.clean_name(n) for n in (" a b ", "c-d", "1st", "_x!", "ok_1")] == ["a_b", "c_d", "_1st", "x", "ok_1"]


def test_dates(value):
    assert [value(dates.weekday_name(F.lit(n))) for n in (1, 7, 9, 0)] == ["Sunday", "Saturday", None, None]
    day = lambda d: F.lit(d).cast("date")
    signs = {"2001-12-22": "Capricorn", "2001-01-19": "Capricorn", "2001-01-20": "Aquarius", "2001-06-20": "Gemini", "2001-11-21": "Scorpio", "2001-12-21": "Sagittarius"}
    assert {d: value(dates.sign_of(day(d))) for d in signs} == signs
    assert value(dates.age_in_years(day("1990-12-31"), day("2020-01-01"))) == 30
    assert str(value(dates.excel_to_timestamp(F.lit(43831)))) == "2020-01-01 00:00:00"
    assert str(value(dates.excel_to_timestamp(F.lit(43831.75)))) == "2020-01-01 18:00:00"
    for text, dayfirst, monthfirst in (("31/12/2001", True, False), ("12-31-01 10:00", False, True), ("5.6.2001", True, True), ("x", False, False), ("30/02/2001", False, False)):
        assert (value(dates.is_dayfirst(F.lit(text))), value(dates.is_monthfirst(F.lit(text)))) == (dayfirst, monthfirst), text
    for text, want in (("2001-02-03", "2001-02-03 00:00:00"), ("2001-02-03 04:05:06", "2001-02-03 04:05:06"), ("20010203", "2001-02-03 00:00:00"),
                       ("13/02/2001", "2001-02-13 00:00:00"), ("02/13/2001", "2001-02-13 00:00:00"), ("2001-02-30", "None"), ("later", "None")):
        assert str(value(dates.parse_date(F.lit(text)))) == want, text
    assert str(value(dates.parse_date(F.lit("03/02/2001"), dayfirst=True))) == "2001-02-03 00:00:00"
    assert str(value(dates.parse_date(F.lit("03/02/2001")))) == "2001-03-02 00:00:00"


def test_arrays(value):
    items = F.array(*[F.lit(x) for x in ("a", "", "b")])
    assert value(arrays.compact(items)) == ["a", "b"]
    assert value(arrays.last(F.array().cast("array<int>"))) is None and value(arrays.last(F.array(F.lit(1), F.lit(2)))) == 2
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert value(arrays.includes(three, 1)) and not value(arrays.includes(three, 1, 2)) and value(arrays.includes(three, 3, 2))
    assert value(arrays.map_over(lambda x, y: x + y, three, F.array(F.lit(10), F.lit(20)))) == [11, 22]
    assert value(arrays.map_over(lambda x, y, z: x + y + z, three, three, three)) == [3, 6, 9]
    assert value(sets.keep_members(F.array(*[F.lit(x) for x in (1, 2, 2, 3)]), F.array(F.lit(2), F.lit(3)))) == [2, 2, 3]
    assert value(sets.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9)))) == {"a": 1, "b": 9}


def test_html(value):
    page = F.lit("<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>var a='<p>';</script><p>Hi <b>there</b></p>"
                 "<a class='c' href=\"http://x.org/1\">one</a><table><tr><td>1</td><td> 2 </td></tr></table></body></html>")
    assert value(html.page_title(page)) == "A & B"
    assert value(html.visible_text(page)) == "A & B Hi there one 1 2"
    assert [(r.href, r.text) for r in value(html.anchors(page))] == [("http://x.org/1", "one")]
    assert value(html.absolute_links(page)) == ["http://x.org/1"] and value(html.table_cells(page)) == [[["1", "2"]]]


def test_numbers(value):
    assert value(numbers.guard_divisor(F.lit(None).cast("double"))) == 1 and value(numbers.guard_divisor(F.lit(0.0))) == 1
    assert value(numbers.fahrenheit(F.lit(100.0))) == 212 and value(numbers.win_rate(F.lit(1.0), F.lit(8.0))) == 0.12


def test_mode_and_repeat(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([2, 4, 1, 2, 3, 3, 4, 4, 5, 4, 4, 6, 4, 6, 7, 4])], "k int, p int, v int")
    assert summary.mode(df, ["k"], "v").first().mode == 4
    assert summary.first_repeat(df, ["k"], "p", "v").first().first_repeat == 2
    single = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "k int, p int, v int")
    assert summary.first_repeat(single, ["k"], "p", "v").first().first_repeat is None


def test_strict_subsets(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["c"],), (["b", "a", "b"],), (None,), ([],), (["d", None],)], "l array<string>")
    kept = sorted((r.l for r in sets.drop_strict_subsets(df, "l").collect()), key=repr)
    assert kept == sorted([["a", "b"], ["b", "a", "b"], ["c"], None, ["d", None]], key=repr)
    assert sets.drop_strict_subsets(df.limit(0), "l").collect() == []
    assert sets.drop_strict_subsets(spark.createDataFrame([([],), ([],)], "l array<int>"), "l").count() == 2


@pytest.mark.parametrize("many", [1_000_000, 30, 0])
def test_strict_subsets_of_any_size_with_a_hot_item(spark, many):
    rng = random.Random(8)
    baskets = {frozenset(rng.sample(range(40), rng.randint(1, 40))) for _ in range(150)} | {frozenset(rng.sample(range(12), rng.randint(1, 6))) for _ in range(250)}
    baskets |= {frozenset([*b, 99]) for b in list(baskets)[:200]}  # an item of half of all sets
    df = spark.createDataFrame([(sorted(b),) for b in baskets], "set array<int>")
    got = {frozenset(r["set"]) for r in sets.strict_subsets(df, many).collect()}
    assert got == {a for a in baskets if any(a < b for b in baskets)}


def test_random_numbers_by_key(spark):
    from tablemill.operators.scaling import normal_of, uniform_of

    df = spark.range(5000).select(uniform_of(F.col("id"), 1).alias("u"), normal_of(F.col("id"), 2).alias("n"), uniform_of(F.col("id"), 3).alias("other"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n"), F.corr("u", "other")).first()
    assert r[0] == pytest.approx(0.5, abs=0.02) and 0 <= r[1] < r[2] < 1
    assert r[3] == pytest.approx(0, abs=0.05) and r[4] == pytest.approx(1, abs=0.05) and abs(r[5]) < 0.05
