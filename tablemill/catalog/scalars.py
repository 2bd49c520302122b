"""Scalar function jobs (F)."""

from pyspark.sql import functions as F

from tablemill.functions import arrays, dates, html, numbers
from tablemill.functions import text as tx
from tablemill.functions.numbers import money
from tablemill.operators import matrix, scaling
from tablemill.registry import job
from tablemill.sources.contract import check_rules, range_rules

BLANKS = "[ \\t\\n\\r\\f]+"
WORDS = f"list_filter(string_split_regex(text, '{BLANKS}'), lambda w: w <> '')"


# ---- text -------------------------------------------------------------------------------

@job("f02_letter_counts", """
    SELECT p_partkey, CAST(length(p_name) - length(replace(lower(p_name), 'e', '')) AS INTEGER) AS e_count,
      (SELECT string_agg(c || n, ',' ORDER BY c) FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c) GROUP BY c)) AS chars,
      (SELECT string_agg(c || n, ',' ORDER BY c) FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), '')) AS c)
        WHERE c IN ('a','e','i','o','u') GROUP BY c)) AS vowels FROM part""")
def letter_counts(t):
    def show(m):
        return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], e["value"].cast("string")))), ",")

    name = F.col("p_name")
    vowels = show(tx.vowel_counts(name))
    return t.part.select("p_partkey", tx.letter_count(name, "e").alias("e_count"), show(tx.char_counts(name)).alias("chars"),
                         F.nullif(vowels, F.lit("")).alias("vowels"))


@job("f03_case_counts", """
    SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z]')) AS INTEGER) AS upper_n,
           CAST(len(regexp_extract_all(text, '[a-z]')) AS INTEGER) AS lower_n FROM documents""")
def case_counts(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[A-Z]")).alias("upper_n"),
                              F.regexp_count("text", F.lit("[a-z]")).alias("lower_n"))


@job("f05_capitalize", """
    SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS capital,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM part""")
def capitalize(t):
    return t.part.select("p_partkey", tx.capitalize_first(F.col("p_name")).alias("capital"), F.initcap("p_name").alias("title"))


@job("f06_truncate", """
    SELECT doc_id, CASE WHEN length(text) >= 40 THEN left(text, 37) || '...' ELSE text END AS short,
           'Tuncation must be at least 3 characters.' AS too_small FROM documents""")
def truncate(t):
    return t.documents.select("doc_id", tx.truncate(F.col("text"), 40).alias("short"), tx.truncate(F.col("text"), 1).alias("too_small"))


@job("f12_money_text", """
    SELECT c_custkey, format('{:,}', CAST(abs(trunc(c_acctbal)) AS BIGINT)) AS grouped,
           '$' || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,}', CAST(trunc(abs(c_acctbal)) AS BIGINT)) || '.' ||
             right(CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR), 2) AS money,
           '$' || lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,}', CAST(trunc(abs(c_acctbal)) AS BIGINT)) || '.' ||
             right(CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR), 2), 15, ' ') AS padded FROM customer""")
def money_text(t):
    balance = F.col("c_acctbal")
    return t.customer.select("c_custkey", tx.thousands(F.abs(balance).cast("bigint")).alias("grouped"),
                             tx.money_text(balance).alias("money"), tx.money_text(balance, 15).alias("padded"))


@job("f13_parse_money", """
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS amount FROM customer""")
def parse_money(t):
    shown = F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.concat(tx.money_text(F.col("c_acctbal")), F.lit(" ")))
    return t.customer.select("c_custkey", tx.parse_money(shown).cast("double").alias("amount"))


@job("f14_mask_account", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE left(lpad(c_custkey::VARCHAR, 8, '0'), 5) || '***' END AS account FROM customer""")
def mask_account(t):
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    raw = F.when(F.col("c_custkey") % 5 == 0, F.substring(digits, 2, 7)).otherwise(
        F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4)))
    return t.customer.select("c_custkey", tx.mask_account(raw).alias("account"))


@job("f15_normal_name", """
    SELECT c_custkey, replace(lower(c_mktsegment || ' ' || c_name), ' ', '_') AS name, c_custkey % 200 BETWEEN 0 AND 150 AS age_ok,
           CASE WHEN c_custkey % 200 BETWEEN 0 AND 150 THEN 59.5::DOUBLE - (c_custkey % 200) END AS remaining FROM customer""")
def normal_name(t, retire_age=59.5):
    age = F.col("c_custkey") % 200
    full = F.concat_ws(" ", "c_mktsegment", "c_name")
    ok = age.between(0, 150)
    return t.customer.select("c_custkey", tx.normal_name(full).alias("name"), ok.alias("age_ok"),
                             F.when(ok, F.lit(retire_age) - age).alias("remaining"))


@job("f16_range_rules", """
    SELECT count(*) FILTER (l_quantity BETWEEN 1 AND 45) AS quantity_ok, count(*) FILTER (l_discount BETWEEN 0 AND 0.05) AS discount_ok,
           count(*) FILTER (l_quantity BETWEEN 1 AND 45 AND l_discount BETWEEN 0 AND 0.05) AS all_ok, count(*) AS n FROM lineitem""")
def range_rule_counts(t):
    flagged = check_rules(t.lineitem, range_rules({"l_quantity": (1, 45), "l_discount": (0, 0.05)}))
    return flagged.agg(F.count_if("l_quantity_ok").alias("quantity_ok"), F.count_if("l_discount_ok").alias("discount_ok"),
                       F.count_if("accepted").alias("all_ok"), F.count(F.lit(1)).alias("n"))


@job("f17_full_name", """
    SELECT conv_id, turn, role || ' ' || conv_id AS full_name, list_extract(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''), -1) AS last_word
    FROM conversations""")
def full_name(t):
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", "role", F.col("conv_id").cast("string")).alias("full_name"),
                                  arrays.last(tx.words(F.col("text"))).alias("last_word"))


@job("f18_email_parts", """
    SELECT p_partkey, string_split(p_name, ' ')[1] AS first_name, string_split(p_name, ' ')[2] AS last_name,
           replace(p_name, ' ', '.') AS user, CAST(length(replace(p_name, ' ', '.')) AS INTEGER) AS user_length, 'example.com' AS domain FROM part""")
def email_parts(t):
    address = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("@example.com"))
    user = F.split_part(address, F.lit("@"), F.lit(1))
    return t.part.select("p_partkey", F.split_part(user, F.lit("."), F.lit(1)).alias("first_name"),
                         F.split_part(user, F.lit("."), F.lit(2)).alias("last_name"), user.alias("user"),
                         F.length(user).alias("user_length"), F.split_part(address, F.lit("@"), F.lit(2)).alias("domain"))


@job("f19_number_after_colon", """
    SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS number FROM events""")
def number_after_colon(t):
    return t.events.select("event_id", tx.number_after_colon(F.col("props")).alias("number"))


@job("f20_addresses_first_seen", """
    WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(\\d+\\.\\d+\\.\\d+\\.\\d+)', '[\\1]', 'g'), chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
         a AS (SELECT unnest(regexp_extract_all(line, '\\[\\d*\\.\\d*\\.\\d*\\.\\d*\\]')) AS address, doc_id, line_no, line FROM l)
    SELECT address, arg_min(doc_id, (doc_id, line_no)) AS doc_id, CAST(arg_min(line_no, (doc_id, line_no)) AS INTEGER) AS line_no,
           arg_min(line, (doc_id, line_no)) AS line FROM a GROUP BY 1""")
def addresses_first_seen(t):
    logged = F.regexp_replace("text", "(\\d+\\.\\d+\\.\\d+\\.\\d+)", "[$1]")
    lines = t.documents.select("doc_id", F.posexplode(tx.lines(logged)).alias("line_no", "line"))
    found = lines.filter(F.contains("line", F.lit("["))).select(
        F.explode(F.regexp_extract_all("line", F.lit("\\[\\d*\\.\\d*\\.\\d*\\.\\d*\\]"), F.lit(0))).alias("address"), "doc_id", "line_no", "line")
    first = F.min(F.struct("doc_id", "line_no", "line")).alias("f")
    return found.groupBy("address").agg(first).select("address", "f.doc_id", "f.line_no", "f.line")


@job("f21_words", f"""
    WITH w AS (SELECT conv_id, turn, {WORDS} AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_sort(l), ' ') AS sorted_words, CAST(len(list_filter(l, lambda x: length(x) >= 5)) AS INTEGER) AS long_words,
           list_aggregate(list_transform(list_distinct(l), lambda x: length(x)), 'sum')::BIGINT AS distinct_length FROM w""")
def split_words(t):
    w = t.conversations.select("conv_id", "turn", tx.words(F.col("text")).alias("l"))
    unique = F.array_distinct("l")
    lengths = F.map_from_arrays(unique, F.transform(unique, lambda x: F.length(x).cast("bigint")))
    return w.select("conv_id", "turn", F.array_join(F.array_sort("l"), " ").alias("sorted_words"),
                    F.size(F.filter("l", lambda x: F.length(x) >= 5)).alias("long_words"),
                    F.aggregate(F.map_values(lengths), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("distinct_length"))


@job("f22_real_lines", """
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) > 1 AND line NOT IN ('Start of List', 'End of List') GROUP BY ALL""")
def real_lines(t, markers=("Start of List", "End of List")):
    lines = t.documents.select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line"))
    return lines.filter((F.length("line") > 1) & ~F.col("line").isin(*markers)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@job("f23_password_rule", """
    SELECT c_custkey, length(w) >= 10 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]') AS strong
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) WHEN c_custkey % 3 = 1 THEN right(c_name, 8) ELSE c_name END AS w FROM customer)""")
def password_rule(t):
    word = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).when(
        F.col("c_custkey") % 3 == 1, F.right("c_name", F.lit(8))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", tx.strong_password(word).alias("strong"))


@job("f24_includes", """
    SELECT p_partkey, list_contains(string_split(p_name, ' '), 'bolt') AS from_start, list_contains(string_split(p_name, ' ')[2:], 'small') AS from_second,
           list_contains([p_brand, p_type], 'ECONOMY') AS in_map FROM part""")
def includes(t):
    name = F.split("p_name", " ")
    mapping = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    return t.part.select("p_partkey", arrays.includes(name, "bolt").alias("from_start"),
                         arrays.includes(name, "small", 1).alias("from_second"), arrays.map_includes(mapping, "ECONOMY").alias("in_map"))


@job("f25_convert_lines", """
    SELECT conv_id, turn, upper(replace(text, 'ß', 'SS')) AS line, role || '!!!' AS loud FROM conversations""")
def convert_lines(t):
    return t.conversations.select("conv_id", "turn", F.upper("text").alias("line"), F.concat("role", F.lit("!!!")).alias("loud"))


# ---- HTML and JSON ----------------------------------------------------------------------

def _unescape_sql(expr):
    for entity, char in html.ENTITIES.items():
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


@job("f30_page_title_and_text", f"""
    SELECT page_id, {_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      trim(regexp_replace({_unescape_sql("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")},
        '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages""")
def page_title_and_text(t):
    return t.pages.select("page_id", html.page_title(F.col("html")).alias("title"), html.visible_text(F.col("html")).alias("text"))


@job("f31_links", """
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS a,
                 generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '(?is)<a\\s+([^>]*)>', 1) AS attributes,
           regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, regexp_extract(a, '(?is)>(.*)</a>', 1) AS text FROM a""")
def links(t):
    return t.pages.select("page_id", F.posexplode(html.anchors(F.col("html"))).alias("pos", "a")).select("page_id", "pos", "a.*")


@job("f31_absolute_links", """
    SELECT page_id, unnest(regexp_extract_all(replace(html, 'href="/', 'href="http://site.example/'), 'href="(http://.*?)"', 1)) AS link FROM pages""")
def absolute_links(t):
    based = F.replace("html", F.lit('href="/'), F.lit('href="http://site.example/'))
    return t.pages.select("page_id", F.explode(html.absolute_links(based)).alias("link"))


@job("f32_html_tables", """
    SELECT c_custkey, i AS row_no, CASE i WHEN 0 THEN 'name' ELSE c_name END AS first_cell,
           CASE i WHEN 0 THEN 'segment' ELSE c_mktsegment || ' & co' END AS second_cell
    FROM customer, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS i)""")
def html_tables(t):
    page = F.concat(F.lit("<p>x</p><table border='1'><tr><th>name</th><th>segment</th></tr><tr><td>"), "c_name",
                    F.lit("</td><td> "), "c_mktsegment", F.lit(" &amp; co</td></tr></table>"))
    rows = t.customer.select("c_custkey", F.explode(html.table_cells(page)).alias("tab")).select(
        "c_custkey", F.posexplode("tab").alias("row_no", "cells"))
    return rows.select("c_custkey", "row_no", F.col("cells")[0].alias("first_cell"), F.col("cells")[1].alias("second_cell"))


def _answers(t):
    """Answer documents derived from events: some without status, some refused, some cut off."""
    body = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.struct(F.col("value").alias("lat"), F.col("user_id").alias("lng")).alias("location")).alias("geometry"),
                         F.col("event_type").alias("formatted_address"))).alias("results"),
        F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, "ZERO_RESULTS").otherwise("OK").alias("status")))
    return t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring(body, 1, 20)).otherwise(body).alias("answer"))


@job("f33_json_paths", """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'results' ELSE 'results,status' END AS keys,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS lat, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_paths(t):
    answers = _answers(t)
    found = answers.select("event_id", F.array_join(F.json_object_keys("answer"), ",").alias("keys"),
                           F.get_json_object("answer", "$.results[0].geometry.location.lat").try_cast("double").alias("lat"))
    whole = F.col("event_id") % 7 != 0
    props = t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return found.join(props, "event_id").select("event_id", "keys", F.when(whole, F.col("lat")).alias("lat"), "k")


@job("f34_status_guard", """
    SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 IN (0, 1) THEN 'failure' ELSE 'found' END AS outcome,
           CASE WHEN event_id % 7 = 0 OR event_id % 5 IN (0, 1) THEN NULL ELSE value END AS lat,
           CASE WHEN event_id % 7 = 0 OR event_id % 5 IN (0, 1) THEN NULL ELSE event_type END AS place FROM events""")
def status_guard(t):
    schema = ("results array<struct<geometry: struct<location: struct<lat: double, lng: bigint>>, formatted_address: string>>, status string")
    parsed = _answers(t).select("event_id", F.from_json("answer", schema).alias("j"))
    ok = F.coalesce(F.col("j.status") == "OK", F.lit(False))
    return parsed.select("event_id", F.when(ok, "found").otherwise("failure").alias("outcome"),
                         F.when(ok, F.col("j.results")[0]["geometry"]["location"]["lat"]).alias("lat"),
                         F.when(ok, F.col("j.results")[0]["formatted_address"]).alias("place"))


# ---- dates ------------------------------------------------------------------------------

@job("f40_weekday_name", """
    SELECT o_orderkey, dayname(o_orderdate) AS weekday, CASE WHEN o_orderkey % 9 BETWEEN 1 AND 7 THEN
      ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][CAST(o_orderkey % 9 AS INTEGER)] END AS of_number FROM orders""")
def weekday_name(t):
    return t.orders.select("o_orderkey", dates.weekday_name(F.dayofweek("o_orderdate")).alias("weekday"),
                           dates.weekday_name((F.col("o_orderkey") % 9).cast("int")).alias("of_number"))


@job("f41_age_and_sign", """
    SELECT o_orderkey, CAST(2020 - year(o_orderdate) AS INTEGER) AS age, CASE
      WHEN md >= 1222 OR md <= 119 THEN 'Capricorn' WHEN md <= 218 THEN 'Aquarius' WHEN md <= 320 THEN 'Pisces' WHEN md <= 419 THEN 'Aries'
      WHEN md <= 520 THEN 'Taurus' WHEN md <= 620 THEN 'Gemini' WHEN md <= 722 THEN 'Cancer' WHEN md <= 822 THEN 'Leo'
      WHEN md <= 922 THEN 'Virgo' WHEN md <= 1022 THEN 'Libra' WHEN md <= 1121 THEN 'Scorpio' ELSE 'Sagittarius' END AS sign
    FROM (SELECT *, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)""")
def age_and_sign(t, today="2020-06-30"):
    day = F.col("o_orderdate")
    return t.orders.select("o_orderkey", dates.age_in_years(day, F.lit(today).cast("date")).alias("age"), dates.sign_of(day).alias("sign"))


@job("f42_excel_serial", """
    WITH s AS (SELECT o_orderkey, date_diff('day', DATE '1899-12-30', o_orderdate::DATE) + (o_orderkey * 7919 % 86400)::DOUBLE / 86400 AS s FROM orders),
         h AS (SELECT *, (s % 1.0::DOUBLE) * 24 AS fh FROM s), r AS (SELECT *, fh - floor(fh) AS r FROM h),
         m AS (SELECT *, r % (1::DOUBLE / 60) AS mr FROM r)
    SELECT o_orderkey, strftime(TIMESTAMP '1899-12-30 00:00:00' + to_days(CAST(floor(s) AS INTEGER)) + to_seconds(CAST(
      floor(fh) * 3600 + round((r - mr) / (1::DOUBLE / 60)) * 60 + floor(mr * 60 * 60) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at FROM m""")
def excel_serial(t):
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    serial = days + (F.col("o_orderkey") * 7919 % 86400).cast("double") / 86400
    return t.orders.select("o_orderkey", F.date_format(dates.excel_to_timestamp(serial), "yyyy-MM-dd HH:mm:ss").alias("at"))


@job("f43_day_or_month_first", """
    WITH d AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS a, strftime(o_orderdate, '%m-%d-%Y') || ' 10:00' AS b, strftime(o_orderdate, '%d.%m.%y') AS c FROM orders),
         l AS (SELECT unnest(['a', 'b', 'c']) AS "column", translate(string_split(unnest([a, b, c]), ' ')[1], '-.,', '///') AS v FROM d)
    SELECT "column", count(*) FILTER (coalesce(try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d/%m/%y')) IS NOT NULL) AS dayfirst,
           count(*) FILTER (coalesce(try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%m/%d/%y')) IS NOT NULL) AS monthfirst,
           dayfirst > monthfirst AS is_dayfirst FROM l GROUP BY 1""")
def day_or_month_first(t):
    from tablemill.plans.profile import day_order

    texts = t.orders.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("a"),
                            F.concat(F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit(" 10:00")).alias("b"),
                            F.date_format("o_orderdate", "dd.MM.yy").alias("c"))
    return day_order(texts, ["a", "b", "c"])


@job("f44_is_date_column", """
    WITH x AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderpriority AS word, CASE WHEN o_orderkey % 50 = 0 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
                 epoch_us(o_orderdate::TIMESTAMP) * 1000 AS nanos, o_orderkey AS small FROM orders),
      r AS (SELECT 'nanos' AS "column", min(nanos)::DOUBLE AS lo, max(nanos)::DOUBLE AS hi FROM x UNION ALL SELECT 'small', min(small)::DOUBLE, max(small)::DOUBLE FROM x)
    SELECT 'iso' AS "column", count(*) FILTER (iso IS NOT NULL AND try_strptime(iso, '%Y-%m-%d') IS NULL) = 0 AS is_date FROM x UNION ALL
    SELECT 'text', count(*) FILTER (word IS NOT NULL AND try_strptime(word, '%Y-%m-%d') IS NULL) = 0 FROM x UNION ALL
    SELECT 'mixed', count(*) FILTER (mixed IS NOT NULL AND try_strptime(mixed, '%Y-%m-%d') IS NULL) = 0 FROM x UNION ALL
    SELECT "column", hi - lo > 86400e9 AND lo > 0 FROM r""")
def is_date_column(t):
    from tablemill.plans.profile import date_like

    columns = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderkey") % 50 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mixed"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("nanos"), F.col("o_orderkey").alias("small"))
    return date_like(columns)


@job("f45_date_key", """
    SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS dt_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def date_key(t):
    key = dates.date_key(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", key.alias("dt_id"), dates.year_of_key(key).alias("year"))


@job("f46_load_stamps", "SELECT o_orderkey, true AS same_stamp, true AS after_order FROM orders")
def load_stamps(t):
    """Both stamps of one load are equal; their value is left out because it changes with every load."""
    loaded = t.orders.withColumns({"insert_dt": F.current_timestamp(), "update_dt": F.current_timestamp()})
    return loaded.select("o_orderkey", (F.col("insert_dt") == F.col("update_dt")).alias("same_stamp"),
                         (F.col("insert_dt") > F.col("o_orderdate").cast("timestamp")).alias("after_order"))


# ---- maths ------------------------------------------------------------------------------

@job("f52_powers_and_roots", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) ** 2 AS square, CAST(p_size AS DOUBLE) ** 3 AS cube, sqrt(p_size) AS root,
           round(exp(p_size / 10.0::DOUBLE), 6) AS exponential, round(sin(p_size), 9) AS sine FROM part""")
def powers_and_roots(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", F.pow(size, 2).alias("square"), F.pow(size, 3).alias("cube"), F.sqrt(size).alias("root"),
                         F.round(F.exp(size / 10.0), 6).alias("exponential"), F.round(F.sin(size), 9).alias("sine"))


@job("f53_unit_conversions", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) * 9 / 5 + 32 AS fahrenheit, p_size * 0.39370::DOUBLE AS inches, p_size * 2.20462::DOUBLE AS pounds,
           p_retailprice / (CAST(p_size AS DOUBLE) * p_size) AS bmi, round(pi() * p_size * p_size, 6) AS area, round(2 * pi() * p_size, 6) AS girth FROM part""")
def unit_conversions(t):
    size = F.col("p_size").cast("double")
    return t.part.select(
        "p_partkey", numbers.fahrenheit(size).alias("fahrenheit"), numbers.inches(size).alias("inches"), numbers.pounds(size).alias("pounds"),
        numbers.body_mass_index(F.col("p_retailprice"), size).alias("bmi"),
        F.round(F.pi() * size * size, 6).alias("area"), F.round(2 * F.pi() * size, 6).alias("girth"))


@job("f54_win_rates", """
    SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_linenumber / l_quantity, 2) AS win_rate,
      round_even(l_quantity * l_quantity / (l_quantity * l_quantity + CAST(l_linenumber AS DOUBLE) * l_linenumber), 2) AS expected FROM lineitem""")
def win_rates(t):
    line = F.col("l_linenumber").cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.win_rate(line, F.col("l_quantity")).alias("win_rate"),
                             numbers.expected_win_rate(F.col("l_quantity"), line).alias("expected"))


@job("f58_random_columns", """
    SELECT o_orderkey, ('0x' || left(md5(o_orderkey || '-7'), 8))::BIGINT::DOUBLE / 4294967296 AS uniform,
           CAST(1 + floor(('0x' || left(md5(o_orderkey || '-7'), 8))::BIGINT::DOUBLE / 4294967296 * 9) AS INTEGER) AS whole,
           round(sqrt(-2 * ln(1 - ('0x' || left(md5(o_orderkey || '-8'), 8))::BIGINT::DOUBLE / 4294967296)) *
             cos(2 * pi() * (('0x' || left(md5(o_orderkey || '-9'), 8))::BIGINT::DOUBLE / 4294967296)), 6) AS normal FROM orders""")
def random_columns(t):
    """Random numbers fixed by key and seed."""
    uniform = scaling.uniform_of(F.col("o_orderkey"), 7)
    return t.orders.select("o_orderkey", uniform.alias("uniform"), F.floor(uniform * 9 + 1).cast("int").alias("whole"),
                           F.round(scaling.normal_of(F.col("o_orderkey"), 8), 6).alias("normal"))


GRID = """a AS (SELECT o_orderstatus AS i, o_orderpriority AS j, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
          b AS (SELECT o_orderstatus AS i, o_orderpriority AS j, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS v FROM orders GROUP BY ALL)"""


def _grids(t):
    keys = [F.col("o_orderstatus").alias("i"), F.col("o_orderpriority").alias("j")]
    return (t.orders.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("v")),
            t.orders.groupBy(*keys).agg(F.count_distinct("o_custkey").cast("double").alias("v")))


@job("f59_matrix_elementwise", f"""
    WITH {GRID} SELECT i, j, a.v + b.v AS added, a.v - b.v AS subtracted, a.v * b.v AS multiplied, a.v / b.v AS divided FROM a JOIN b USING (i, j)""")
def matrix_elementwise(t):
    return matrix.elementwise(*_grids(t))


@job("f59_matrix_product", f"""
    WITH {GRID} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM a JOIN b USING (j) GROUP BY ALL""")
def matrix_product(t):
    a, b = _grids(t)
    return matrix.product(a, matrix.transpose(b))


@job("f59_matrix_mask", f"""
    WITH {GRID} SELECT i, j, v FROM a WHERE v > (SELECT avg(v) FROM a) AND j <= '3-MEDIUM'""")
def matrix_mask(t):
    a, _ = _grids(t)
    return matrix.slice_rows(matrix.mask(a, F.col("v") > a.agg(F.avg("v")).scalar()), "j", None, "3-MEDIUM")


@job("f60_z_score", """
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) /
      (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS z FROM lineitem""")
def z_score(t):
    scored = scaling.standardize(t.lineitem, "l_extendedprice", "z")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round("z", 6).alias("z"))


@job("f61_min_max_scale", """
    WITH s AS (SELECT *, ('0x' || left(md5(p_partkey || '-1'), 8))::BIGINT % 100 < 20 AS test FROM part),
         f AS (SELECT min(p_retailprice) AS lo, max(p_retailprice - lo_) AS width FROM (SELECT *, min(p_retailprice) OVER () AS lo_ FROM s WHERE NOT test))
    SELECT p_partkey, test, (p_retailprice - lo) / width AS scaled, (p_retailprice - lo) / width * 15 + 15 AS marker FROM s, f""")
def min_max_scale(t):
    """Both parts use the training constants; the published notebook rescales the test part by itself."""
    split = scaling.train_test_split(t.part, "p_partkey", 20, seed=1)
    scaled = scaling.min_max_scale(split, "p_retailprice", "scaled", fit_on=~F.col("test"))
    return scaled.select("p_partkey", "test", "scaled", (F.col("scaled") * 15 + 15).alias("marker"))


# ---- arrays -----------------------------------------------------------------------------

@job("f70_compact", """
    SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_name, 'red', ''), ' '), lambda x: x <> ''), ',') AS words,
           CAST(len(list_filter([p_size % 2, p_size % 3, NULL, p_size], lambda x: x IS NOT NULL AND x <> 0)) AS INTEGER) AS numbers FROM part""")
def compact(t):
    words = F.split(F.replace("p_name", F.lit("red"), F.lit("")), " ")
    nums = F.array(F.col("p_size") % 2, F.col("p_size") % 3, F.lit(None).cast("int"), F.col("p_size"))
    return t.part.select("p_partkey", F.array_join(arrays.compact(words), ",").alias("words"), F.size(arrays.compact_numbers(nums)).alias("numbers"))


@job("f72_items_and_slices", """
    SELECT vec_id, embedding[-1]::DOUBLE AS last_item, embedding[3]::DOUBLE AS third, list_sum(embedding[2:4]::DOUBLE[]) AS slice_sum,
           embedding[100000]::DOUBLE AS beyond FROM embeddings""")
def items_and_slices(t):
    e = F.col("embedding")
    piece = F.aggregate(F.slice(e, 2, 3), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.embeddings.select("vec_id", arrays.last(e).cast("double").alias("last_item"), e[2].cast("double").alias("third"),
                               piece.alias("slice_sum"), F.try_element_at(e, F.lit(100000)).cast("double").alias("beyond"))


@job("f73_edit_lists", f"""
    WITH w AS (SELECT conv_id, turn, {WORDS} AS l FROM conversations),
         e AS (SELECT conv_id, turn, list_append(list_filter(l, lambda x: x <> 'the'), 'end') AS l FROM w)
    SELECT conv_id, turn, CAST(len(l) AS INTEGER) AS size, array_to_string(list_reverse_sort(l), ' ') AS reversed FROM e""")
def edit_lists(t):
    edited = F.array_append(F.array_remove(tx.words(F.col("text")), "the"), F.lit("end"))
    return t.conversations.select("conv_id", "turn", F.size(edited).alias("size"),
                                  F.array_join(F.reverse(F.array_sort(edited)), " ").alias("reversed"))


@job("f74_map_over_lists", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_linenumber AS first_product, 2 AS n, l_quantity * l_quantity AS squared,
           l_quantity + l_linenumber + 1 AS three_sum FROM lineitem""")
def map_over_lists(t):
    a, b = F.array("l_quantity", "l_discount", "l_tax"), F.array(F.col("l_linenumber").cast("double"), F.lit(2.0))
    products = arrays.map_over(lambda x, y: x * y, a, b)
    squared = F.transform_values(F.create_map(F.lit("q"), "l_quantity"), lambda k, v: v * v)
    three = arrays.map_over(lambda x, y, z: x + y + z, a, b, F.array(F.lit(1.0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", products[0].alias("first_product"), F.size(products).alias("n"),
                             F.element_at(squared, "q").alias("squared"), three[0].alias("three_sum"))
