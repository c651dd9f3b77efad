"""Queries of functions/parsing.py over raw strings made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import parsing as P
from granary.queries.base import query


#: Endings of names: two legal suffixes, none, and letters beyond ASCII.
_ENDINGS = ("", " SARL", " L.L.C.", " LP", " Pvt", " Œuvre Ltd", " Łódź Private", " Straße GmbH", " Søn Co.", " Жуков Щи Ltd", " Αθήνα Ψυχή", " 北京公司 Inc")
_ENDING = "CASE company_id % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ENDINGS)) + " END"


@query(
    "fn_names",
    f"""WITH n AS (SELECT company_id, name, replace(replace(lower(trim(strip_accents(replace(replace(replace(replace(name || {_ENDING}, 'Œ', 'OE'), 'Ł', 'L'), 'ß', 'ss'), 'ø', 'o')))), 'жуков щи', 'zhukov shchi'), 'αθηνα ψυχη', 'athena psukhe') AS low FROM companies)
    SELECT company_id, trim(regexp_replace(regexp_replace(regexp_replace(low, '\\b(limited|ltd|inc|incorporated|llc|l\\.l\\.c\\.|plc|p\\.l\\.c\\.|corp|corporation|co|company|gmbh|ag|sa|sas|sarl|pty|pvt|private)\\.?\\s*$', ''), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS legal,
    trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || name || ' Capital Partners'), '[^a-z0-9]+', ' ', 'g'), '\\b(the|inc|llc|ltd|limited|plc|corp|corporation|partners|capital|ventures)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS investor,
    trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS watchlist FROM n""",
)
def names(t):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("company_id") % 12 + 1).cast("int"))
    return t.companies.select("company_id", P.normalized_name(F.concat("name", ending)).alias("legal"), P.investor_name(F.concat(F.lit("The "), "name", F.lit(" Capital Partners"))).alias("investor"), P.watchlist_name(F.col("name")).alias("watchlist"))


_RAW = """raw AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, CASE o_orderkey % 6 WHEN 0 THEN '$' || floor(o_totalprice)::BIGINT::VARCHAR || '.50' WHEN 1 THEN 'n/a' WHEN 2 THEN (o_orderkey % 90)::VARCHAR || '%'
    WHEN 3 THEN '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') WHEN 4 THEN '' ELSE (o_orderkey % 900)::VARCHAR END AS num,
    CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS yn,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN upper(strftime(o_orderdate, '%d-%b-%Y')) ELSE 'unknown' END AS ds,
    CASE o_orderkey % 4 WHEN 0 THEN '12.5 million' WHEN 1 THEN (o_orderkey % 900)::VARCHAR || 'k' WHEN 2 THEN '$3,200' ELSE 'none' END AS scaled FROM orders)"""


def raw(t):
    k, m = F.col("o_orderkey"), lambda n: F.col("o_orderkey") % n
    d = F.col("o_orderdate")
    return t.orders.select(
        k.alias("k"),
        F.to_date(d).alias("d"),
        F.when(m(6) == 0, F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(".50"))).when(m(6) == 1, "n/a").when(m(6) == 2, F.concat(m(90).cast("string"), F.lit("%"))).when(m(6) == 3, F.concat(F.lit("1,"), F.lpad(m(1000).cast("string"), 3, "0"))).when(m(6) == 4, "").otherwise(m(900).cast("string")).alias("num"),
        F.when(m(5) == 0, "Yes").when(m(5) == 1, " n ").when(m(5) == 2, "TRUE").when(m(5) == 3, "0").otherwise("maybe").alias("yn"),
        F.when(m(5) == 0, F.date_format(d, "yyyy-MM-dd")).when(m(5) == 1, F.date_format(d, "yyyyMMdd")).when(m(5) == 2, F.date_format(d, "MM/dd/yyyy")).when(m(5) == 3, F.upper(F.date_format(d, "dd-MMM-yyyy"))).otherwise("unknown").alias("ds"),
        F.when(m(4) == 0, "12.5 million").when(m(4) == 1, F.concat(m(900).cast("string"), F.lit("k"))).when(m(4) == 2, "$3,200").otherwise("none").alias("scaled"),
    )


@query(
    "fn_numbers",
    f"""WITH {_RAW}, b AS (SELECT *, regexp_replace(num, '[$,\\s]', '', 'g') AS bare FROM raw), v AS (SELECT *, CASE WHEN bare LIKE '%\\%' ESCAPE '\\' THEN try_cast(replace(bare, '%', '') AS DOUBLE) / 100 ELSE try_cast(bare AS DOUBLE) END AS value FROM b)
    SELECT k, value, trunc(value)::BIGINT AS whole, CASE WHEN lower(trim(yn)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(yn)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag,
    CASE k % 4 WHEN 0 THEN 12500000.0::DOUBLE WHEN 1 THEN (k % 900) * 1000.0::DOUBLE WHEN 2 THEN 3200.0::DOUBLE END AS amount FROM v""",
)
def numbers(t):
    return raw(t).select("k", P.number(F.col("num")).alias("value"), P.whole(F.col("num")).alias("whole"), P.flag(F.col("yn")).alias("flag"), P.scaled_amount(F.col("scaled")).alias("amount"))


@query(
    "fn_dates",
    f"""WITH {_RAW}, s AS (SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE d END AS parsed, d FROM raw)
    SELECT k, parsed, year(d)::VARCHAR || '-Q' || quarter(d)::VARCHAR AS quarter, date_trunc('week', d)::DATE AS week, date_trunc('quarter', d)::DATE AS quarter_start,
    (greatest(date_diff('day', d, DATE '1999-01-01'), 0) // 30)::INTEGER AS months, ((1999 - year(d)) * 12 + 1 - month(d))::INTEGER AS calendar_months,
    make_date(year(d), quarter(d) * 3 - 1, 15) AS quarter_mid, (d + INTERVAL 18 MONTH)::DATE AS matures FROM s""",
)
def dates(t):
    end = F.lit("1999-01-01").cast("date")
    d = F.col("d")
    source_id = F.concat(F.lit("77_q"), F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return raw(t).select("k", P.date_of(F.col("ds")).alias("parsed"), P.quarter_label(d).alias("quarter"), F.trunc(d, "week").alias("week"), F.trunc(d, "quarter").alias("quarter_start"), P.age_months(d, end).alias("months"), P.calendar_months(d, end).alias("calendar_months"), P.quarter_mid(source_id).alias("quarter_mid"), F.add_months(d, 18).alias("matures"))


@query(
    "fn_ids",
    """SELECT round_id, coalesce(nullif(ltrim(lpad((round_id % 97)::VARCHAR, 10, '0'), '0'), ''), '0') AS cik, split_part(round_id::VARCHAR || '_q2024Q1', '_q', 1) AS source_id,
    coalesce(nullif(ltrim(substr(lpad((round_id % 53)::VARCHAR, 10, '0') || '24000123', 1, 10), '0'), ''), '0') AS filer,
    company_id::VARCHAR || ':' || strftime(round_date, '%Y-%m-%d') || ':' || lower(priority) || ':' || lower(security) || ':' || CASE WHEN pre_money IS NULL THEN 'unknown' ELSE printf('%.2f', round(pre_money, 2)) END AS round_key FROM rounds""",
)
def ids(t):
    k = F.col("round_id")
    accession = F.concat(F.lpad((k % 53).cast("string"), 10, "0"), F.lit("-24-000123"))
    return t.rounds.select("round_id", P.cik(F.lpad((k % 97).cast("string"), 10, "0")).alias("cik"), F.split_part(F.concat(k.cast("string"), F.lit("_q2024Q1")), F.lit("_q"), F.lit(1)).alias("source_id"), P.filer_of_accession(accession).alias("filer"), P.round_key(F.col("company_id"), F.col("round_date"), F.col("priority"), F.col("security"), F.round("pre_money", 2)).alias("round_key"))


@query(
    "fn_categories",
    """SELECT round_id, CASE WHEN security IN ('Convertible Note', 'Debt') THEN 'convertible_note' WHEN security = 'SAFE' THEN 'safe' ELSE 'equity' END AS instrument,
    CASE round_id % 6 WHEN 0 THEN 'rule_506c' WHEN 1 THEN 'rule_506b' WHEN 2 THEN 'rule_504' WHEN 3 THEN 'section_4a5' WHEN 4 THEN 'rule_506' ELSE 'reg_d' END AS exemption,
    CASE round_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'exited' WHEN 2 THEN 'trading' WHEN 3 THEN 'failed' ELSE 'unknown' END AS outcome,
    CASE WHEN amount * 4 >= 1000000 OR pre_money >= 5000000 THEN 'early_growth' ELSE 'seed' END AS stage,
    CASE round_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, CASE WHEN round_id % 2 = 0 THEN 'UK' ELSE 'US' END || '_' || CASE WHEN round_id % 5 < 3 THEN 'EarlyGrowth' ELSE 'Seed' END AS segment,
    CASE round_id % 4 WHEN 0 THEN 'fintech' WHEN 1 THEN 'health' ELSE 'other' END AS sector FROM rounds""",
)
def categories(t):
    k = F.col("round_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    return t.rounds.select(
        "round_id",
        P.instrument_of(F.col("security")).alias("instrument"),
        P.exemption_round(pick(6, "06b,06c", "06b", "04", "4(a)(5)", "06", "3C")).alias("exemption"),
        P.outcome_of(pick(5, "Dissolved", "Acquired by X", "Active", "in liquidation", "?")).alias("outcome"),
        P.stage_of(F.col("amount") * 4, F.col("pre_money")).alias("stage"),
        P.tier_of(pick(3, "sec_edgar", "Manual research", "blog")).alias("tier"),
        P.segment_of(pick(2, " gb ", "USA"), pick(5, "early_growth", "Angel", " bridge", "seed", "pre-seed")).alias("segment"),
        P.allowed(pick(4, "FinTech ", "health", "astrology", None), ("fintech", "health", "energy")).alias("sector"),
    )


#: Sentences of offering texts; which of them a text has is drawn by its number.
_SENTENCES = (
    ("true", "'We offer SAFEs with a valuation cap of $' || (k % 40 + 1)::STRING || ' million.'"),
    ("k % 2 = 0", "'Holders get a ' || (k % 30)::STRING || '% discount. 5% interest accrues.'"),
    ("k % 2 = 1", "'Discount rate of ' || (k % 30)::STRING || '.5%, interest rate: 7%.'"),
    ("k % 3 = 0", "'The pre-money valuation is $8,000,000 and post money valuation = 9.5m.'"),
    ("k % 4 = 0", "'With a 1.5x liquidation preference, non-participating.'"),
    ("k % 4 = 1", "'Participating preferred with liquidation preference of 2x.'"),
    ("k % 5 = 0", "'No pro rata rights are granted.'"),
    ("k % 5 = 1", "'Pro-rata rights apply.'"),
    ("k % 7 < 2", "'The notes mature on 2027-0' || (k % 9 + 1)::STRING || '-15.'"),
    ("k % 7 = 2", "'Maturity date: March 3, 2027.'"),
    ("k % 6 = 0", "'The round was led by Example Ventures, L.P.'"),
)
_TEXT = "concat_ws(' ', " + ", ".join(f"CASE WHEN {w} THEN {x} END" for w, x in _SENTENCES) + ")"
_TEXTS = f"texts AS (SELECT k, {_TEXT} AS t FROM (SELECT round_id AS k FROM rounds))"


def offering_texts(t):
    return t.rounds.select(F.col("round_id").alias("k")).withColumn("t", F.expr(_TEXT))


def _sql(patterns: tuple[str, ...], text: str) -> str:
    return "coalesce(" + ", ".join("nullif(regexp_extract({}, '{}', 1), '')".format(text, p.replace("'", "''")) for p in patterns) + ")"


def _amount_sql(name: str) -> str:
    x = _sql(P.TERM_PATTERNS[name], "lower(t)")
    return f"try_cast(replace(regexp_extract({x}, '[\\d,.]+'), ',', '') AS DOUBLE) * CASE regexp_extract({x}, '[a-z]+') WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1 END"


_SHOWN = ("valuation_cap", "pre_money", "post_money", "discount_rate", "interest_rate", "maturity_date", "liquidation_pref", "participation", "pro_rata", "lead_investor")


@query(
    "fn_terms",
    f"""WITH {_TEXTS}, f AS (SELECT k, {_amount_sql('valuation_cap')} AS valuation_cap, {_amount_sql('pre_money')} AS pre_money, {_amount_sql('post_money')} AS post_money,
    try_cast({_sql(P.TERM_PATTERNS['discount_rate'], 'lower(t)')} AS DOUBLE) / 100 AS discount_rate, try_cast({_sql(P.TERM_PATTERNS['interest_rate'], 'lower(t)')} AS DOUBLE) / 100 AS interest_rate,
    strftime(try_cast(CASE WHEN {_sql(P.TERM_PATTERNS['maturity_date'], 't')} LIKE '____-__-__' THEN {_sql(P.TERM_PATTERNS['maturity_date'], 't')} END AS DATE), '%Y-%m-%d') AS maturity_date,
    try_cast({_sql(P.TERM_PATTERNS['liquidation_pref'], 'lower(t)')} AS DOUBLE) AS liquidation_pref,
    CASE WHEN regexp_matches(lower(t), 'non[-\\s]?participating') THEN 'non_participating' WHEN regexp_matches(lower(t), '\\bparticipating\\b') THEN 'participating' END AS participation,
    CASE WHEN regexp_matches(lower(t), 'no\\s+pro[-\\s]?rata') THEN false WHEN regexp_matches(lower(t), 'pro[-\\s]?rata') THEN true END AS pro_rata,
    trim({_sql(P.TERM_PATTERNS['lead_investor'], 't')}, ' .,') AS lead_investor FROM texts)
    SELECT *, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT k AS round_id, * EXCLUDE (k) FROM f) JOIN (SELECT k AS id, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in _SHOWN)}) AS n FROM f) ON id = round_id""".replace("SELECT *, CASE", "SELECT * EXCLUDE (n, id), CASE"),
)
def terms(t):
    found = P.terms(F.col("t"))
    return offering_texts(t).select(F.col("k").alias("round_id"), *[found[c].alias(c) for c in _SHOWN], P.term_confidence(found).alias("confidence"))


@query(
    "fn_filing_terms",
    f"""WITH {_TEXTS}, x AS (SELECT k, lower(replace(t, ' million', ',000,000')) AS t FROM texts) SELECT k AS round_id, try_cast(replace({_sql(P.FILING_PATTERNS['valuation_cap'], 't')}, ',', '') AS DOUBLE) AS valuation_cap, try_cast({_sql(P.FILING_PATTERNS['discount_rate'], 't')} AS DOUBLE) / 100 AS discount_rate,
    try_cast({_sql(P.FILING_PATTERNS['liquidation_pref'], 't')} AS DOUBLE) AS liquidation_pref, CASE WHEN contains(t, 'pro rata') OR contains(t, 'pro-rata') THEN true END AS pro_rata,
    CASE WHEN contains(t, 'participating preferred') THEN 'participating' WHEN contains(t, 'non-participating') THEN 'non_participating' END AS participation FROM x""",
)
def filing_terms(t):
    found = P.filing_terms(F.replace(F.col("t"), F.lit(" million"), F.lit(",000,000")))
    return offering_texts(t).select(F.col("k").alias("round_id"), *[v.alias(c) for c, v in found.items()])


#: References, an inline tag inside a word, and elements without text of their own.
_PIECE = "<p>Caf&#233; &#8212; &quot;x&quot; &#128512; in<b>line</b> &amp;lt;</p><NAV class=x>menu <a>one</a></nav><svg><text>axis</text></svg><iframe src=y>none</iframe><Footer>end</footer>"


@query(
    "fn_html_text",
    f"""WITH p AS (SELECT page_id, html || '{_PIECE}' AS html FROM pages), a AS (SELECT page_id, html, regexp_replace(html, '(?is){"|".join(f"<{x}[^>]*>.*?</{x}>" for x in P.NO_TEXT)}', ' ', 'g') AS x FROM p),
    b AS (SELECT page_id, html, regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM a),
    c AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS x FROM b),
    d AS (SELECT page_id, html, list_reduce(list_prepend(x, list_distinct(regexp_extract_all(x, '&#([0-9]{{1,7}});', 1))), lambda done, n: replace(done, '&#' || n || ';', chr(n::INTEGER))) AS x FROM c)
    SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM d""",
)
def html(t):
    page = F.concat("html", F.lit(_PIECE))
    return t.pages.select("page_id", P.html_title(page).alias("title"), P.html_text(page).alias("text"))


@query("fn_json_value", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_value(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("fn_lenient_json", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id || '+' || (event_id % 7) END AS found FROM events")
def lenient_json(t):
    said = F.when(F.col("event_id") % 3 == 0, "no list here").otherwise(F.concat(F.lit("Sure! Here it is:\n["), F.col("event_id").cast("string"), F.lit(", "), (F.col("event_id") % 7).cast("string"), F.lit("]\nDone.")))
    return t.events.select("event_id", F.array_join(F.from_json(F.nullif(F.regexp_extract(said, r"(?s)\[.*\]", 0), F.lit("")), "array<bigint>"), "+").alias("found"))


@query(
    "fn_math",
    """SELECT deal_id, round(CASE WHEN score <= 0 OR score >= 100 THEN 0.0::DOUBLE ELSE -(score / 100 * log2(score / 100) + (1 - score / 100) * log2(1 - score / 100)) END, 6) AS entropy, greatest(least(score * 2, 90.0::DOUBLE), 10.0::DOUBLE) AS clamped,
    floor(score + 0.5)::BIGINT AS rounded FROM deals""",
)
def math(t):
    s = F.col("score")
    return t.deals.select("deal_id", F.round(P.entropy(s / 100), 6).alias("entropy"), P.clamp(s * 2, 10.0, 90.0).alias("clamped"), P.half_up(s).alias("rounded"))


@query(
    "fn_quiet_hours",
    "SELECT event_id, (hour(ts) >= 22 OR hour(ts) < 7) AS at_night, (hour(ts) >= 12 AND hour(ts) < 14) AS at_noon, (event_type = 'error' OR NOT (hour(ts) >= 22 OR hour(ts) < 7)) AS send FROM events",
)
def quiet(t):
    hour = F.hour("ts")
    return t.events.select("event_id", P.is_quiet(hour, 22, 7).alias("at_night"), P.is_quiet(hour, 12, 14).alias("at_noon"), ((F.col("event_type") == "error") | ~P.is_quiet(hour, 22, 7)).alias("send"))


@query(
    "fn_profile_text",
    "SELECT company_id, concat_ws(chr(10), 'Company: ' || name, 'Sector: ' || sector, CASE WHEN balance > 0 THEN 'Cash: ' || floor(balance)::BIGINT::VARCHAR END, CASE WHEN outcome <> 'unknown' THEN 'Outcome: ' || outcome END) AS profile FROM companies",
)
def profile(t):
    c = F.col
    lines = [F.concat(F.lit("Company: "), "name"), F.concat(F.lit("Sector: "), "sector"), F.when(c("balance") > 0, F.concat(F.lit("Cash: "), F.floor("balance").cast("string"))), F.when(c("outcome") != "unknown", F.concat(F.lit("Outcome: "), "outcome"))]
    return t.companies.select("company_id", F.concat_ws("\n", *lines).alias("profile"))
