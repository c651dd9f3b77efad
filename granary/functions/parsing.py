"""Tolerant parsing of names, numbers, dates, ids and categories as Column expressions; whatever cannot be read is null."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that one name may end in.
LEGAL_SUFFIXES = ("limited", "ltd", "inc", "incorporated", "llc", "l.l.c.", "plc", "p.l.c.", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "sas", "sarl", "pty", "pvt", "private")
#: Words without meaning in an investor's name.
INVESTOR_WORDS = ("the", "inc", "llc", "ltd", "limited", "plc", "corp", "corporation", "partners", "capital", "ventures")
#: Letters that are no plain letter with a mark, and what stands for them.
SPELLED = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Þ": "Th", "þ": "th", "Ĳ": "IJ", "ĳ": "ij", "Ŋ": "NG", "ŋ": "ng"}
_STROKES = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ı": "i", "ĸ": "k", "ſ": "s", "\u00a0": " "}


def _plain_letters() -> dict[str, str]:
    """Each Latin letter with marks and the plain one."""
    found = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    return {c: x for c, x in found.items() if x != c and x.isascii()} | _STROKES


MARKED, PLAIN = map("".join, zip(*_plain_letters().items(), strict=True))


#: Latin spellings of Cyrillic and Greek letters, small ones; signs without a sound are left out.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o", "ά": "a", "έ": "e", "ή": "e", "ί": "i", "ό": "o", "ύ": "u", "ώ": "o",
}


def latin(x: Column) -> Column:
    """Small Cyrillic and Greek letters in Latin spelling; texts without any are left alone."""
    out, letters = x, CYRILLIC | GREEK
    for c, spelled in letters.items():
        if len(spelled) > 1:
            out = F.replace(out, F.lit(c), F.lit(spelled))
    single = {c: s for c, s in letters.items() if len(s) == 1}
    out = F.translate(out, "".join(single) + "ъь", "".join(single.values()))
    return F.when(x.rlike("[\u0370-\u04ff]"), out).otherwise(x)


def plain(x: Column) -> Column:
    """Latin letters without marks, ligatures spelled out."""
    for c, spelled in SPELLED.items():
        x = F.replace(x, F.lit(c), F.lit(spelled))
    return F.translate(x, MARKED, PLAIN)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def normalized_name(x: Column) -> Column:
    """Plain lower-case letters and digits, without one legal suffix at the end, single blanks. Cyrillic and Greek letters are
    spelled in Latin ones; letters of other scripts stay as they are, so their names are told apart."""
    low = latin(F.lower(F.trim(plain(x))))
    cut = F.regexp_replace(low, rf"\b({'|'.join(map(re.escape, LEGAL_SUFFIXES))})\.?\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def investor_name(x: Column) -> Column:
    spaced = F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, rf"\b({'|'.join(INVESTOR_WORDS)})\b", " "), r"\s+", " "))


def watchlist_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def number(x: Column) -> Column:
    """Without `$` and `,`; with `%` a hundredth; never NaN or infinite."""
    bare = F.trim(F.regexp_replace(x, r"[$,\s]", ""))
    percent = bare.endswith("%")
    v = F.regexp_replace(bare, "%$", "").try_cast("double")
    v = F.when(percent, v / 100).otherwise(v)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def whole(x: Column) -> Column:
    return number(x).cast("decimal(38,6)").try_cast("bigint")


def flag(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)


def date_of(x: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "d-MMM-yyyy")) -> Column:
    return F.coalesce(*[F.try_to_date(F.initcap(F.trim(x)) if "MMM" in f else F.trim(x), f) for f in formats])


def scaled_amount(x: Column) -> Column:
    """"12.5 million", "750k": the first number with its unit."""
    pattern = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|bn|b|million|mm|m|thousand|k)?\b"
    v = F.regexp_replace(F.regexp_extract(x, pattern, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(x, pattern, 2))
    return v * F.when(unit.isin("billion", "bn", "b"), 1e9).when(unit.isin("million", "mm", "m"), 1e6).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)


def cik(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(x), "^0+", ""), F.lit("")), F.lit("0"))


def filer_of_accession(x: Column) -> Column:
    return cik(F.substring(F.regexp_replace(x, "[^0-9]", ""), 1, 10))


def quarter_mid(source_id: Column) -> Column:
    """The middle of the quarter that an id of the form `…_q2024Q3` names."""
    year, q = F.regexp_extract(source_id, r"_q(\d{4})Q([1-4])", 1).try_cast("int"), F.regexp_extract(source_id, r"_q(\d{4})Q([1-4])", 2).try_cast("int")
    return F.make_date(year, q * 3 - 1, F.lit(15))


def round_key(company: Column, date: Column, kind: Column, instrument: Column, amount: Column) -> Column:
    known = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    return F.concat_ws(":", company.cast("string"), F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("unknown")), known(kind), known(instrument), F.when(amount.isNull(), "unknown").otherwise(F.format_string("%.2f", amount)))


def instrument_of(security: Column) -> Column:
    low = F.lower(security)
    return F.when(low.contains("debt") | low.contains("note"), "convertible_note").when(low.contains("safe"), "safe").otherwise("equity")


def exemption_round(items: Column) -> Column:
    """The round type of a list of exemptions, by the strongest."""
    low, has = F.lower(items), lambda *xs: F.lower(items).rlike("|".join(xs))
    return F.when(has("06c"), "rule_506c").when(has("06b"), "rule_506b").when(has("04") & ~has("06"), "rule_504").when(low.contains("4(a)(5)"), "section_4a5").when(has("06"), "rule_506").otherwise("reg_d")


def outcome_of(text: Column, failed: Column | None = None) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    by = F.when(low.rlike("dissolv|fail|liquidat|closed|bankrupt|insolv"), "failed").when(low.rlike("exit|acqui|ipo|merged"), "exited").when(low.rlike("active|trading|operat|alive"), "trading").otherwise("unknown")
    return by if failed is None else F.when(failed, "failed").otherwise(by)


def stage_of(raised: Column, valuation: Column) -> Column:
    return F.when((raised >= 1_000_000) | (valuation >= 5_000_000), "early_growth").otherwise("seed")


def segment_of(country: Column, stage: Column) -> Column:
    """Place and stage. Any "a" or "b" in the stage makes it early growth, as published: "angel" and "bridge" too."""
    tidy_ = lambda c: F.trim(F.coalesce(c, F.lit("")))
    place = F.when(F.upper(tidy_(country)).isin("UK", "GB", "UNITED KINGDOM"), "UK").otherwise("US")
    return F.concat_ws("_", place, F.when(F.lower(tidy_(stage)).rlike("[ab]|early|growth"), "EarlyGrowth").otherwise("Seed"))


def tier_of(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(low.rlike("sec|edgar|companies_house|form_d|official"), "A").when(low.rlike("academic|manual|audit"), "B").otherwise("C")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "A", 3).when(tier == "B", 2).when(tier == "C", 1).otherwise(0)


def allowed(label: Column, labels: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.isin(*labels), low).otherwise("other")


def entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def age_months(start: Column, at: Column) -> Column:
    """Whole spans of thirty days, none before the start; null without both dates."""
    days = F.datediff(at, start)
    return F.when(days.isNotNull(), F.floor(F.greatest(days, F.lit(0)) / 30)).cast("int")


def calendar_months(start: Column, at: Column) -> Column:
    return (F.year(at) - F.year(start)) * 12 + F.month(at) - F.month(start)


def is_quiet(hour: Column, start: int, end: int) -> Column:
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def character(code: Column) -> Column:
    """The character of a code point, the replacement character where there is none."""
    sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


#: Elements of a page that hold no text of it, and the references that are decoded by name.
NO_TEXT = ("script", "style", "nav", "footer", "header", "noscript", "svg", "iframe")
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Readable text of a page: without elements that hold none, and comments; each tag is a blank, named and decimal character references are
    decoded. Texts without a reference skip that step."""
    x = F.regexp_replace(html, rf"(?is)<({'|'.join(NO_TEXT)})[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    named = x
    for name, char in REFERENCES:
        named = F.replace(named, F.lit(name), F.lit(char))
    x = F.when(x.contains("&"), named).otherwise(x)
    numbers = F.array_distinct(F.regexp_extract_all(x, F.lit("&#([0-9]{1,7});"), 1))
    decimal = F.aggregate(numbers, x, lambda done, n: F.replace(done, F.concat(F.lit("&#"), n, F.lit(";")), character(n.cast("int"))))
    return F.trim(F.regexp_replace(F.when(x.contains("&#"), decimal).otherwise(x), r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: Patterns of terms in offering texts (lower case but for dates and names), tried in order.
TERM_PATTERNS = {
    "pre_money": (r"pre[-\s]?money\s+valuation(?:\s*(?:of|is|:|=))?\s*\$?\s*([\d,]+(?:\.\d+)?\s*(?:k|m|b|million|billion)?)",),
    "post_money": (r"post[-\s]?money\s+valuation(?:\s*(?:of|is|:|=))?\s*\$?\s*([\d,]+(?:\.\d+)?\s*(?:k|m|b|million|billion)?)",),
    "valuation_cap": (r"valuation\s+cap(?:\s*(?:of|:|=))?\s*\$?\s*([\d,]+(?:\.\d+)?\s*(?:k|m|b|million|billion)?)",),
    "discount_rate": (r"discount(?:\s+rate)?(?:\s*(?:of|:|=))?\s*(\d{1,2}(?:\.\d+)?)\s*%", r"(\d{1,2}(?:\.\d+)?)\s*%\s*discount",),
    "interest_rate": (r"interest(?:\s+rate)?(?:\s*(?:of|:|=))?\s*(\d{1,2}(?:\.\d+)?)\s*%", r"(\d{1,2}(?:\.\d+)?)\s*%\s*interest",),
    "maturity_date": (r"(?i)matur(?:ity|es?)(?:\s+date)?(?:\s*(?:on|:|=))?\s*([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})",),
    "liquidation_pref": (r"(\d(?:\.\d+)?)x\s+liquidation\s+preference", r"liquidation\s+preference(?:\s*(?:of|:|=))?\s*(\d(?:\.\d+)?)x",),
    "lead_investor": (r"(?:led\s+by|lead\s+investor[:\s])\s*([A-Z][A-Za-z0-9&.,' -]{2,60})",),
}
#: Patterns of terms in filings of notes.
FILING_PATTERNS = {
    "valuation_cap": (r"valuation\s+cap[^\d$]{0,40}\$?([\d,]{4,})",),
    "discount_rate": (r"([0-9]{1,2}(?:\.[0-9]+)?)\s*%\s*discount",),
    "liquidation_pref": (r"([0-9](?:\.[0-9])?)x\s+liquidation\s+preference",),
}
_NO_RATA, _RATA, _NOT_PARTICIPATING, _PARTICIPATING = r"no\s+pro[-\s]?rata", r"pro[-\s]?rata", r"non[-\s]?participating", r"\bparticipating\b"


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[_found(text, p) for p in patterns])


def terms(text: Column) -> dict[str, Column]:
    """Deal terms named in an offering text, by name; null where the text has none. Dates are ISO dates alone."""
    low = F.lower(text)
    of = lambda name: _first(text if name in ("maturity_date", "lead_investor") else low, TERM_PATTERNS[name])
    share = lambda name: of(name).try_cast("double") / 100
    return {
        "valuation_cap": scaled_amount(of("valuation_cap")),
        "pre_money": scaled_amount(of("pre_money")),
        "post_money": scaled_amount(of("post_money")),
        "discount_rate": share("discount_rate"),
        "interest_rate": share("interest_rate"),
        "maturity_date": F.date_format(F.try_to_date(F.substring(of("maturity_date"), 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd"),
        "liquidation_pref": of("liquidation_pref").try_cast("double"),
        "participation": F.when(low.rlike(_NOT_PARTICIPATING), "non_participating").when(low.rlike(_PARTICIPATING), "participating"),
        "pro_rata": F.when(low.rlike(_NO_RATA), False).when(low.rlike(_RATA), True),
        "lead_investor": F.btrim(of("lead_investor"), F.lit(" .,")),
    }


def filing_terms(text: Column) -> dict[str, Column]:
    """Terms named in a filing of notes: stricter patterns, and any mention of pro rata counts."""
    low = F.lower(text)
    of = lambda name: _first(low, FILING_PATTERNS[name])
    return {
        "valuation_cap": number(of("valuation_cap")),
        "discount_rate": of("discount_rate").try_cast("double") / 100,
        "liquidation_pref": of("liquidation_pref").try_cast("double"),
        "pro_rata": F.when(low.contains("pro rata") | low.contains("pro-rata"), True),
        "participation": F.when(low.contains("participating preferred"), "participating").when(low.contains("non-participating"), "non_participating"),
    }


def term_confidence(found: dict[str, Column]) -> Column:
    n = sum((c.isNotNull().cast("int") for c in found.values()), F.lit(0))
    return F.when(n >= 4, "high").when(n >= 2, "medium").otherwise("low")
