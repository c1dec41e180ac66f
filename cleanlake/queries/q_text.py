"""Queries for text (2.8), date and time (2.9), geospatial (2.10) and related declared operators (2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanlake.core import c, rnd
from cleanlake.functions import text as X
from cleanlake.operators import geo as G
from cleanlake.operators import temporal as TM
from cleanlake.operators import textops as TX
from cleanlake.queries.fixtures import ora, table
from cleanlake.queries.q_profile import rounded
from cleanlake.queries.registry import query
from cleanlake.queries.sqltext import R

W = r"[\p{L}\p{N}_]"
S = r"[\s\x0B\x{0085}\p{Z}]"


def td(s, d):
    return table(s, d, "text_dirty")


def expr_query(key, fn, sql_expr, source="text_dirty", col="text", id_="doc_id"):
    query(key, ora(source, f"SELECT {id_}, {sql_expr} AS {col} FROM {source}"))(
        lambda s, d: table(s, d, source).select(id_, fn(c(col)).alias(col)))


def rx(x, pattern, repl=""):
    return f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"


STRIP = rx(rx("text", f"^{S}+"), f"{S}+$")
COLLAPSE = rx("text", f"{S}+", " ")
WORDS = f"list_filter(regexp_split_to_array(text, '{S}+'), lambda w: w <> '')"
STOP = "(" + ", ".join(f"'{w}'" for w in X.COMMON_WORDS) + ")"
EMAIL, URL = X.EMAIL_RE, X.URL_RE
expr_query("text_strip", X.strip, STRIP)
expr_query("text_collapse_spaces", X.collapse_spaces, COLLAPSE)
expr_query("text_lower", X.lower, "lower(text)")
expr_query("text_upper", X.upper, "upper(p_name)", "part", "p_name", "p_partkey")
expr_query("text_title", X.title, "array_to_string(list_transform(string_split(lower(text), ' '), lambda w: concat(CASE WHEN substr(w, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END, substr(w, 2))), ' ')")
expr_query("text_sentence", X.sentence, "concat(upper(substr(text, 1, 1)), lower(substr(text, 2)))")
expr_query("text_remove_numbers", X.remove_numbers, rx("text", r"\p{Nd}+"))
expr_query("text_remove_punctuation", X.remove_punctuation, rx("text", r"[^\p{L}\p{N}_\s\x0B\x{0085}\p{Z}]"))
expr_query("text_remove_special", X.remove_special, rx("text", r"[^a-zA-Z0-9\s\x0B\x{0085}\p{Z}]"))
expr_query("text_remove_urls", X.remove_urls, rx("text", URL))
expr_query("text_remove_emails", X.remove_emails, rx("text", EMAIL))
expr_query("text_remove_phones", X.remove_phones, rx("text", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"))
expr_query("text_remove_html", X.remove_html, rx("html", r"<[^<>]*>"), "pages", "html", "page_id")
expr_query("text_standardize_ws", X.standardize_ws, f"trim({COLLAPSE})")
query("text_unique_words", ora("text_dirty", f"""WITH w AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i FROM text_dirty) GROUP BY 1, 2)
  SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS text FROM text_dirty LEFT JOIN w USING (doc_id) GROUP BY doc_id"""))(
    lambda s, d: td(s, d).select("doc_id", X.unique_words(c("text")).alias("text")))
query("text_custom_regex", ora("text_dirty", f"SELECT doc_id, {rx('text', '([a-z])ing', '<1>')} AS text FROM text_dirty".replace("<1>", r"\1ed")))(
    lambda s, d: td(s, d).select("doc_id", X.custom_regex(c("text"), "([a-z])ing", "$1ed").alias("text")))
expr_query("text_line_breaks", X.line_breaks, rx("text", r"\r\n|\r|\n", " "))
expr_query("text_fix_quotes", X.fix_quotes, "translate(text, '’“”', '''\"\"')")
query("text_chain", ora("text_dirty", "SELECT doc_id, " + f"trim({rx(rx('lower(' + rx(rx('text', URL), EMAIL) + ')', r'[^\p{L}\p{N}_\s\x0B\x{0085}\p{Z}]'), S + '+', ' ')})" + " AS text FROM text_dirty"))(
    lambda s, d: TX.apply(td(s, d), "text", ["remove_urls", "remove_emails", "lowercase", "remove_punctuation", "remove_extra_spaces"]).select("doc_id", "text"))
query("batch_text", ora("text_dirty", f"SELECT doc_id, lower(lang) AS lang, trim({rx('lower(text)', S + '+', ' ')}) AS text FROM text_dirty"))(lambda s, d: TX.auto_clean(td(s, d)))
query("text_auto_clean", ora("text_dirty", f"SELECT doc_id, lower(lang) AS lang, trim({rx('lower(text)', S + '+', ' ')}) AS text FROM text_dirty"))(lambda s, d: TX.auto_clean(td(s, d)))
query("text_stats", ora("text_dirty", " UNION ALL ".join(f"""SELECT '{x}' AS "column", count({x}) AS "values", count(DISTINCT {x}) AS "unique", {R(f'avg(length({x}))')} AS mean_length, CAST(min(length({x})) AS INT) AS min_length, CAST(max(length({x})) AS INT) AS max_length,
  count(*) FILTER (WHERE {x} = '') AS empty, count(*) FILTER (WHERE regexp_full_match({x}, '\\p{{Nd}}+')) AS numeric_only FROM text_dirty""" for x in ("lang", "text"))))(lambda s, d: rounded(TX.stats(td(s, d))))
query("text_length_stats", f"SELECT {R('avg(length(text))')} AS mean, {R('quantile_cont(length(text), 0.5)')} AS median, CAST(min(length(text)) AS INT) AS min, CAST(max(length(text)) AS INT) AS max FROM documents")(
    lambda s, d: rounded(TX.length_stats(table(s, d, "documents"), "text")))
query("text_length_hist", f"""WITH l AS (SELECT length(text) AS n FROM documents), m AS (SELECT min(n) AS lo, max(n) AS hi FROM l), e AS (SELECT CAST(range AS BIGINT) AS bin FROM range(30)),
  h AS (SELECT CAST(least(floor((n - lo) * 30.0 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS rows FROM l, m GROUP BY 1)
  SELECT e.bin, {R('lo + e.bin * ((hi - lo) / 30.0)')} AS low, {R('lo + (e.bin + 1) * ((hi - lo) / 30.0)')} AS high, coalesce(rows, 0) AS rows FROM m, e LEFT JOIN h ON h.bin = e.bin""")(
    lambda s, d: rounded(TX.length_histogram(table(s, d, "documents"), "text")))
query("text_totals", f"SELECT CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len({WORDS})) AS BIGINT) AS words FROM documents")(lambda s, d: TX.totals(table(s, d, "documents"), "text"))
FREQ = lambda where: f"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents) {where} GROUP BY 1 ORDER BY count DESC, word LIMIT 10"
query("text_word_freq", FREQ(""))(lambda s, d: TX.word_frequency(table(s, d, "documents"), "text"))
query("text_keywords", FREQ(f"WHERE word NOT IN {STOP} AND length(word) > 2"))(lambda s, d: TX.keywords(table(s, d, "documents"), "text"))
ISS = [("url", "regexp_matches(text, '(?i)http|www')"), ("email", r"regexp_matches(text, '@.*\.')"), ("phone", r"regexp_matches(text, '\d{3}[-.]?\d{3}[-.]?\d{4}')"), ("html", "regexp_matches(text, '<.*?>')"),
       ("extra_spaces", f"regexp_matches(text, '{S}{{2,}}')"), ("all_caps", r"regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}')"), ("numeric", r"regexp_full_match(text, '\p{N}+')")]
query("text_issue_counts", ora("text_dirty", " UNION ALL ".join(f"SELECT '{k}' AS issue, count(*) FILTER (WHERE {v}) AS rows FROM text_dirty" for k, v in ISS)))(lambda s, d: TX.issue_counts(td(s, d), "text"))
query("text_empty_stats", ora("text_dirty", " UNION ALL ".join(f"""SELECT '{x}' AS "column", count(*) FILTER (WHERE {x} = '') AS empty, {R(f"100.0 * count(*) FILTER (WHERE {x} = '') / count(*)")} AS empty_pct, {R(f'avg(length({x}))')} AS mean_length FROM text_dirty""" for x in ("lang", "text"))))(
    lambda s, d: rounded(TX.empty_stats(td(s, d))))
expr_query("text_remove_stopwords", X.remove_stopwords, f"array_to_string(list_filter({WORDS}, lambda w: lower(w) NOT IN {STOP}), ' ')")


def lexicon(s, d):
    """Polarity per word from the labelled documents: mean quality of its occurrences on -2..2, drawn to 0 as by 20 more uses."""
    w = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("quality", F.explode(X.char_words(c("text"))).alias("word"))
    return w.groupBy("word").agg(((F.sum("quality") * 4 - F.count(F.lit(1)) * 2) / (F.count(F.lit(1)) + 20.0)).alias("polarity"))


LEX = f"""lex AS (SELECT word, (sum(quality) * 4 - count(*) * 2) / (count(*) + 20.0) AS polarity FROM (SELECT quality, unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents JOIN labels USING (doc_id)) GROUP BY word),
  w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents), v AS (SELECT d.doc_id, w.word, coalesce(polarity, 0.0) AS p, polarity FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN lex USING (word))"""
query("text_sentiment_class", f"WITH {LEX} SELECT doc_id, {R('coalesce(avg(polarity), 0)')} AS polarity, CASE WHEN coalesce(avg(polarity), 0) > 0.1 THEN 'Positive' WHEN coalesce(avg(polarity), 0) < -0.1 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM v GROUP BY doc_id")(
    lambda s, d: rounded(TX.sentiment_class(table(s, d, "documents"), "text", "doc_id", lexicon(s, d))))
query("text_sentiment_scores", f"""WITH {LEX}, g AS (SELECT doc_id, coalesce(sum(p + 1) FILTER (WHERE p > 0), 0) AS p, coalesce(sum(1 - p) FILTER (WHERE p < 0), 0) AS n, count(word) FILTER (WHERE p = 0) AS z, sum(p) AS s FROM v GROUP BY doc_id)
  SELECT doc_id, {R('CASE WHEN p + n + z > 0 THEN p / (p + n + z) ELSE 0 END')} AS pos, {R('CASE WHEN p + n + z > 0 THEN n / (p + n + z) ELSE 0 END')} AS neg, {R('CASE WHEN p + n + z > 0 THEN z / (p + n + z) ELSE 0 END')} AS neu, {R('s / sqrt(s * s + 15)')} AS compound FROM g""")(
    lambda s, d: rounded(TX.sentiment_scores(table(s, d, "documents"), "text", "doc_id", lexicon(s, d))))
query("recommend_text", ora("text_dirty", f"""SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{x}' AS "column", max(regexp_matches({x}, '{S}{{2,}}')) AS extra_space, max(regexp_matches({x}, '[^{W[1:-1]}{S[1:-1]}]')) AS special_characters,
  max(regexp_matches({x}, '\\p{{Ll}}') AND NOT regexp_matches({x}, '\\p{{Lu}}')) AND max(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '\\p{{Ll}}')) AS mixed_case FROM text_dirty''' for x in ('lang', 'text'))}) WHERE extra_space OR special_characters OR mixed_case"""))(
    lambda s, d: TX.recommend(td(s, d)))


# Written out by hand: RE2 has no look-behind, so the border before a whole word is captured and put back.
EXPAND = [(r"(^|[^\p{L}])that's", r"\1that is"), (r"(^|[^\p{L}])shan't", r"\1shall not"), (r"(^|[^\p{L}])won't", r"\1will not"), (r"(^|[^\p{L}])can't", r"\1cannot"),
          (r"(^|[^\p{L}])let's", r"\1let us"), (r"(^|[^\p{L}])she's", r"\1she is"), (r"(^|[^\p{L}])he's", r"\1he is"), (r"(^|[^\p{L}])it's", r"\1it is"),
          (r"'ll", " will"), (r"'re", " are"), (r"'ve", " have"), (r"n't", " not"), (r"'m", " am")]


def _contract(x):
    for k, v in EXPAND:
        quoted = k.replace("'", "''")
        n = v.removeprefix(r"\1")
        # the border after the word is captured as well; twice, since neighbours share it
        back = (r"\1" + n + r"\2") if k.startswith("(") else n + r"\1"
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i){quoted}([^\\p{{L}}]|$)', '{back}', 'g')"
    return x


expr_query("text_expand_contractions", X.expand_contractions, _contract("text"))
CNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"
query("text_readability", f"SELECT doc_id, {R('CASE WHEN nw > 0 THEN 206.835 - 1.015 * nw / sn - 84.6 * sy / nw END')} AS flesch FROM (SELECT doc_id, {CNT(W + '+')} AS nw, CAST(greatest({CNT('[.!?]+')}, 1) AS DOUBLE) AS sn, CAST(greatest({CNT('[aeiouyAEIOUY]+')}, 1) AS DOUBLE) AS sy FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", rnd(X.readability(c("text"))).alias("flesch")))
query("text_language")(lambda s, d: table(s, d, "documents").select("doc_id", "lang", X.language(c("text")).alias("detected")))

# ---------------------------------------------------------------- date and time
ev = lambda s, d: table(s, d, "events")
query("dt_detect", ora("orders_dirty", f"""SELECT 'o_orderdate' AS "column", 'datetime' AS stored_as, 1.0 + 0.0E0 AS rate UNION ALL SELECT 'date_text', 'text', {R('count(coalesce(try_strptime(date_text, $$%Y-%m-%d$$), try_strptime(date_text, $$%d/%m/%Y$$))) * 1.0 / count(date_text)')} FROM orders_dirty"""))(
    lambda s, d: rounded(TM.detect(table(s, d, "orders_dirty"))))
query("dt_stats", """SELECT count(*) AS rows, count(ts) AS valid, count(*) - count(ts) AS invalid, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS range_days, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last,
  (SELECT CAST(year(ts) AS INT) FROM events GROUP BY year(ts) ORDER BY count(*) DESC, year(ts) LIMIT 1) AS common_year, (SELECT CAST(month(ts) AS INT) FROM events GROUP BY month(ts) ORDER BY count(*) DESC, month(ts) LIMIT 1) AS common_month FROM events""")(
    lambda s, d: TM.stats(ev(s, d), "ts").withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd")))
DV = lambda s, d: table(s, d, "orders_dirty").select("o_orderkey", "copy", F.expr("try_to_timestamp(date_text, 'yyyy-MM-dd')").cast("timestamp_ntz").alias("when"))
DVS = "v AS (SELECT o_orderkey, copy, try_strptime(date_text, '%Y-%m-%d') AS w FROM orders_dirty)"
query("dt_validate", ora("orders_dirty", f"WITH {DVS} SELECT count(w) AS valid, count(*) - count(w) AS invalid FROM v"))(lambda s, d: TM.validate(DV(s, d), "when"))


def _fix(s, d):
    df = DV(s, d)
    out = [TM.fix_invalid(df, "when", h).select(F.lit(h).alias("how"), "o_orderkey", "copy", F.date_format("when", "yyyy-MM-dd HH:mm").alias("fixed")) for h in ("drop", "median", "latest", "earliest")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


query("dt_fix_invalid", ora("orders_dirty", f"WITH {DVS} SELECT 'drop' AS how, o_orderkey, copy, strftime(w, '%Y-%m-%d %H:%M') AS fixed FROM v WHERE w IS NOT NULL" + "".join(
    f" UNION ALL SELECT '{h}', o_orderkey, copy, strftime(coalesce(w, (SELECT {e} FROM v)), '%Y-%m-%d %H:%M') FROM v" for h, e in [("median", "make_timestamp(CAST(floor(quantile_cont(epoch_us(w), 0.5)) AS BIGINT))"), ("latest", "max(w)"), ("earliest", "min(w)")])))(_fix)
for _u, _e in (("year", "CAST(year(o_orderdate) AS INT)"), ("month", "strftime(o_orderdate, '%Y-%m')"), ("day", "strftime(o_orderdate, '%Y-%m-%d')")):
    query(f"dt_counts_{_u}", f"SELECT {_e} AS {_u}, count(*) AS rows FROM orders GROUP BY 1")(lambda s, d, u=_u: TM.counts(table(s, d, "orders"), "o_orderdate", u))
query("dt_parts", """SELECT event_id, CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(day(ts) AS INT) AS ts_day, CAST(isodow(ts) - 1 AS INT) AS ts_weekday, CAST(week(ts) AS INT) AS ts_week, CAST(quarter(ts) AS INT) AS ts_quarter,
  CAST(hour(ts) AS INT) AS ts_hour, CAST(minute(ts) AS INT) AS ts_minute, CAST(dayofyear(ts) AS INT) AS ts_dayofyear FROM events""")(lambda s, d: TM.parts(ev(s, d).select("event_id", "ts"), "ts").drop("ts"))
query("dt_flags", "SELECT event_id, CAST(isodow(ts) >= 6 AS INT) AS ts_is_weekend, CAST(CAST(ts AS DATE) = last_day(ts) AS INT) AS ts_is_month_end, CAST(day(ts) = 1 AS INT) AS ts_is_month_start FROM events")(
    lambda s, d: TM.flags(ev(s, d).select("event_id", "ts"), "ts").drop("ts"))
query("dt_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS o_orderdate_season FROM orders")(
    lambda s, d: TM.season(table(s, d, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate_season"))
query("dt_time_period", "SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END AS ts_time_period FROM events")(
    lambda s, d: TM.time_period(ev(s, d), "ts").select("event_id", "ts_time_period"))
query("dt_days_since_first", "SELECT event_id, CAST(floor(epoch(ts - (SELECT min(ts) FROM events)) / 86400) AS BIGINT) AS ts_days_since_start FROM events")(lambda s, d: TM.days_since_first(ev(s, d), "ts").select("event_id", "ts_days_since_start"))
query("dt_days_until_last", "SELECT event_id, CAST(floor(epoch((SELECT max(ts) FROM events) - ts) / 86400) AS BIGINT) AS ts_days_until_end FROM events")(lambda s, d: TM.days_until_last(ev(s, d), "ts").select("event_id", "ts_days_until_end"))
query("dt_business_days", """WITH m AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders), cal AS (SELECT CAST(d AS DATE) AS d, sum(CASE WHEN isodow(d) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS n FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM m))
  SELECT o_orderkey, CAST(n AS BIGINT) AS o_orderdate_bdays_since_start FROM orders JOIN cal ON cal.d = CAST(o_orderdate AS DATE)""")(lambda s, d: TM.business_days(table(s, d, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate_bdays_since_start"))
query("dt_age_years", f"SELECT o_orderkey, {R('floor(epoch(TIMESTAMP $$2024-01-01 00:00:00$$ - o_orderdate) / 86400) / 365.25')} AS o_orderdate_age_years FROM orders")(
    lambda s, d: rounded(TM.age_years(table(s, d, "orders"), "o_orderdate", "2024-01-01 00:00:00").select("o_orderkey", "o_orderdate_age_years")))
query("dt_seconds_midnight", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS ts_seconds_since_midnight FROM events")(lambda s, d: TM.seconds_midnight(ev(s, d), "ts").select("event_id", "ts_seconds_since_midnight"))
query("dt_cyclical", "SELECT event_id, " + ", ".join(f"{R(f'{f}(2 * pi() * {e})')} AS ts_{n}_{f}" for n, e in [("month", "month(ts) / 12.0"), ("weekday", "(isodow(ts) - 1) / 7.0")] for f in ("sin", "cos")) + " FROM events")(
    lambda s, d: rounded(TM.cyclical(ev(s, d).select("event_id", "ts"), "ts").drop("ts")))
query("dt_auto_extract", "SELECT event_id, CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(isodow(ts) - 1 AS INT) AS ts_weekday FROM events")(lambda s, d: TM.auto_extract(ev(s, d).select("event_id", "ts")).drop("ts"))

PE = {"D": "CAST({0} AS DATE)", "W": "CAST(date_trunc('week', {0}) + INTERVAL 6 DAY AS DATE)", "M": "last_day({0})", "Q": "last_day(CAST(date_trunc('quarter', {0}) + INTERVAL 2 MONTH AS DATE))", "Y": "last_day(CAST(date_trunc('year', {0}) + INTERVAL 11 MONTH AS DATE))"}
HOWS = [("D", "sum"), ("W", "mean"), ("M", "median"), ("Q", "count"), ("Y", "max"), ("W", "min")]


def _series(p, h):
    agg = {"sum": "sum(v)", "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "count": "count(v)", "max": "max(v)", "min": "min(v)"}[h]
    e = "0" if h in ("sum", "count") else "NULL"
    return f"""SELECT '{p}' AS freq, '{h}' AS how, strftime(cal.p, '%Y-%m-%d') AS period, {R(f'CASE WHEN g.p IS NULL THEN {e} ELSE g.v END + 0.0000123')} AS value FROM (SELECT DISTINCT {PE[p].format('d')} AS p FROM (SELECT unnest(generate_series((SELECT {PE[p].format('min(t)')} FROM x), (SELECT {PE[p].format('max(t)')} FROM x), INTERVAL 1 DAY)) AS d)) cal
  LEFT JOIN (SELECT {PE[p].format('t')} AS p, {agg} AS v FROM x GROUP BY 1) g ON g.p = cal.p"""


def _resample(s, d):
    df = table(s, d, "orders_dirty").where("o_totalprice IS NOT NULL")
    out = None
    for p, h in HOWS:
        one = TM.resample(df, "o_orderdate", "o_totalprice", p, h).select(F.lit(p).alias("freq"), F.lit(h).alias("how"), F.date_format("period", "yyyy-MM-dd").alias("period"), rnd(F.col("value") + 0.0000123).alias("value"))  # moves averages of cents off rounding ties
        out = one if out is None else out.unionByName(one)
    return out


SRC = "x AS (SELECT o_orderdate AS t, o_totalprice AS v FROM orders_dirty WHERE o_totalprice IS NOT NULL)"
query("ts_resample", ora("orders_dirty", f"WITH {SRC} " + " UNION ALL ".join(_series(*ph) for ph in HOWS)))(_resample)
query("ts_resample_stats", ora("orders_dirty", f"WITH {SRC}, r AS ({_series('W', 'mean')}) SELECT count(*) AS periods, min(period) AS first, max(period) AS last, {R('avg(value)', 2)} AS mean, {R('stddev_samp(value)', 2)} AS std, {R('min(value)', 2)} AS min, {R('max(value)', 2)} AS max FROM r"))(
    lambda s, d: rounded(TM.resample_stats(TM.resample(table(s, d, "orders_dirty"), "o_orderdate", "o_totalprice", "W", "mean")).withColumn("first", F.date_format("first", "yyyy-MM-dd")).withColumn("last", F.date_format("last", "yyyy-MM-dd")), 2))
GV = "x AS (SELECT event_id, ts, value FROM events_gaps WHERE value IS NOT NULL)"
query("ts_rolling_mean", ora("events_gaps", f"WITH {GV} SELECT event_id, {R('CASE WHEN row_number() OVER (ORDER BY ts, event_id) >= 30 THEN avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END')} AS rolling_mean FROM x"))(
    lambda s, d: rounded(TM.rolling_mean(table(s, d, "events_gaps"), "ts", "value", ["ts", "event_id"]).select("event_id", "rolling_mean")))
query("ts_trend", ora("events_gaps", f"""WITH {GV}, i AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM x), t AS (SELECT avg(value) FILTER (WHERE i < n // 2) AS a, avg(value) FILTER (WHERE i >= n // 2) AS b FROM i)
  SELECT {R('a')} AS first_half, {R('b')} AS second_half, CASE WHEN b > a THEN 'Upward' ELSE 'Downward' END AS direction, {R('abs(b - a)')} AS magnitude FROM t"""))(
    lambda s, d: rounded(TM.trend(table(s, d, "events_gaps"), "ts", "value", ["ts", "event_id"])))

# ---------------------------------------------------------------- geospatial
cg = lambda s, d: table(s, d, "customer_geo")
LL = ("latitude", "longitude")
HAV = lambda a, b, x, y: f"2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians({x}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({x})) * power(sin((radians({y}) - radians({b})) / 2), 2))))"
OKC = "coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)"
query("geo_detect", ora("customer_geo", 'SELECT \'latitude\' AS kind, \'latitude\' AS "column", count(latitude) AS known FROM customer_geo UNION ALL SELECT \'longitude\', \'longitude\', count(longitude) FROM customer_geo'))(lambda s, d: G.detect(cg(s, d)))
query("geo_validate", ora("customer_geo", f"SELECT p AS pairs, v AS valid, p - v AS invalid, {R('100.0 * v / p')} AS valid_pct FROM (SELECT count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS p, count(*) FILTER (WHERE {OKC}) AS v FROM customer_geo)"))(
    lambda s, d: rounded(G.validate(cg(s, d), *LL)))


def _geofix(s, d):
    df = cg(s, d).select("c_custkey", *LL)
    flag = G.fix_invalid(df, *LL, "flag")
    gone = G.fix_invalid(df, *LL, "remove").withColumn("coordinate_valid", F.lit(None).cast("boolean"))
    null = G.fix_invalid(df, *LL, "null").withColumn("coordinate_valid", F.lit(None).cast("boolean"))
    return flag.withColumn("how", F.lit("flag")).unionByName(gone.withColumn("how", F.lit("remove"))).unionByName(null.withColumn("how", F.lit("null")))


query("geo_fix_invalid", ora("customer_geo", f"SELECT c_custkey, latitude, longitude, {OKC} AS coordinate_valid, 'flag' AS how FROM customer_geo UNION ALL SELECT c_custkey, latitude, longitude, NULL, 'remove' FROM customer_geo WHERE {OKC} UNION ALL SELECT c_custkey, CASE WHEN {OKC} THEN latitude END, CASE WHEN {OKC} THEN longitude END, NULL, 'null' FROM customer_geo"))(_geofix)
query("geo_clip", ora("customer_geo", "SELECT c_custkey, CASE WHEN latitude IS NOT NULL THEN greatest(-90.0, least(90.0, latitude)) END AS latitude, greatest(-180.0, least(180.0, longitude)) AS longitude FROM customer_geo"))(
    lambda s, d: G.clip(cg(s, d), *LL).select("c_custkey", *LL))
query("geo_haversine", ora("customer_geo", f"SELECT c_custkey, {R(HAV('40.0', '-100.0', 'latitude', 'longitude'), 3)} AS km FROM customer_geo"))(
    lambda s, d: cg(s, d).select("c_custkey", rnd(G.haversine(F.lit(40.0), F.lit(-100.0), c("latitude"), c("longitude")), 3).alias("km")))


def _distref(s, d):
    df = G.fix_invalid(cg(s, d), *LL, "remove")
    out = None
    for how in ("centroid", "first"):
        p = G.reference_point(df, *LL, how, ["c_custkey"])
        one = rounded(G.distance_stats(G.distance_to(df, *LL, p)), 3).select(F.lit(how).alias("reference"), "*")
        out = one if out is None else out.unionByName(one)
    return out


DREF = lambda how, pt: f"SELECT '{how}' AS reference, {R('avg(km)', 3)} AS mean, {R('quantile_cont(km, 0.5)', 3)} AS median, {R('min(km)', 3)} AS min, {R('max(km)', 3)} AS max, {R('stddev_pop(km)', 3)} AS std FROM (SELECT {HAV('a', 'b', 'latitude', 'longitude')} AS km FROM g, ({pt}))"
query("geo_distance_ref", ora("customer_geo", f"WITH g AS (SELECT * FROM customer_geo WHERE {OKC}) " + DREF("centroid", "SELECT avg(latitude) AS a, avg(longitude) AS b FROM g") + " UNION ALL " + DREF("first", "SELECT latitude AS a, longitude AS b FROM g ORDER BY c_custkey LIMIT 1")))(_distref)
BOUNDS = lambda rows: f"""WITH b AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS x, max(longitude) AS y, avg(latitude) AS m, avg(longitude) AS k FROM {rows})
  SELECT {R('a')} AS lat_min, {R('b')} AS lat_max, {R('x')} AS lon_min, {R('y')} AS lon_max, {R('m')} AS lat_mean, {R('k')} AS lon_mean, {R('b - a')} AS lat_range, {R('y - x')} AS lon_range,
  CASE WHEN (a + b) / 2 BETWEEN -48 AND 71 AND (x + y) / 2 BETWEEN -168 AND -52 THEN 'North America' ELSE 'other' END AS region FROM b"""
query("geo_bounds", ora("customer_geo", BOUNDS(f"customer_geo WHERE {OKC}")))(lambda s, d: rounded(G.bounds(G.fix_invalid(cg(s, d), *LL, "remove"), *LL)))
query("geo_density", ora("customer_geo", f"""WITH g AS (SELECT * FROM customer_geo WHERE {OKC}), m AS (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS x, max(longitude) AS y, least(10, greatest(3, CAST(floor(sqrt(count(*))) AS INT))) AS k FROM g),
  t AS (SELECT CAST(least(floor((latitude - a) * k / (b - a)), k - 1) AS BIGINT) AS lat_cell, CAST(least(floor((longitude - x) * k / (y - x)), k - 1) AS BIGINT) AS lon_cell, count(*) AS points FROM g, m GROUP BY 1, 2)
  SELECT lat_cell, lon_cell, {R('a + (lat_cell + 0.5) * ((b - a) / k)')} AS lat_center, {R('x + (lon_cell + 0.5) * ((y - x) / k)')} AS lon_center, points, points = (SELECT max(points) FROM t) AS densest FROM t, m"""))(
    lambda s, d: rounded(G.density(G.fix_invalid(cg(s, d), *LL, "remove"), *LL)))
query("geo_mean_center_sample", ora("customer_geo", BOUNDS(f"(SELECT * FROM customer_geo WHERE {OKC} ORDER BY md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '42')), c_custkey LIMIT 500)")))(
    lambda s, d: rounded(G.bounds(G.sample_points(G.fix_invalid(cg(s, d), *LL, "remove"), *LL, "c_custkey", 500, ["c_acctbal", "c_mktsegment"]), *LL)))
