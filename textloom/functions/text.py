"""Text functions as column expressions; all stay inside whole-stage code generation where Spark allows it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The diacritics that folding removes, their plain letters, and two deleted apostrophes.
FOLD_FROM = "āīūṛṝḷḹṃṁḥṅñṭḍṇśṣĀĪŪṚṜḶḸṀḤṄÑṬḌṆŚṢ'’"
FOLD_TO = "aiurrllmmhnntdnssAIURRLLMHNNTDNSS"
FOLD_PAIRS = (("sh", "s"), ("ri", "r"), ("ee", "i"))
#: Capital letters that the strict table lacks but lower-casing first would cover.
FOLD_EXTRA = ("Ṃ", "M")
DIGITS = "०१२३४५६७८९"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold(col: Column | str, strict: bool = True) -> Column:
    """Diacritic-insensitive key; null is empty. ``strict`` keeps the reference table; else every letter
    of it is covered in both cases."""
    x = F.coalesce(_c(col), F.lit(""))
    if not strict:
        x = F.translate(x, *FOLD_EXTRA)
    x = F.lower(F.translate(x, FOLD_FROM, FOLD_TO))
    for a, b in FOLD_PAIRS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ref_parts(col: Column | str) -> Column:
    """Sortable key of a dotted reference of any depth: its numbers, then the rank of a letter suffix.
    ``1.2.9 < 1.13.40 < 1.13.40b``. Parts that are not numbers count as 0."""
    ref = F.coalesce(_c(col), F.lit(""))
    numbers = F.split(F.regexp_replace(ref, "[^0-9.]+$", ""), "[.]")
    numbers = F.transform(numbers, lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    suffix = F.when(ref.rlike("[a-z]$"), F.ascii(F.right(ref, F.lit(1))) - 96).otherwise(F.lit(0))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 8)), 1, 8)
    return F.concat(padded, F.array(suffix))


def tokens(folded: Column | str) -> Column:
    """Words of folded text: runs of letters, marks and digits."""
    return F.filter(F.split(_c(folded), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def folded(query: str) -> str:
    """``fold`` of a query, its ends trimmed, on the driver."""
    q = query.strip()
    for a, b in zip(FOLD_FROM, FOLD_TO, strict=False):
        q = q.replace(a, b)
    q = q.translate({ord(c): None for c in FOLD_FROM[len(FOLD_TO) :]}).lower()
    for a, b in FOLD_PAIRS:
        q = q.replace(a, b)
    return q


def word_runs(text: str) -> list[tuple[int, int]]:
    """Places [start, end) of the runs of letters, marks and digits, the words of ``tokens``."""
    runs: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if unicodedata.category(c)[0] in "LMN":
            runs[-1:] = [(runs[-1][0], i + 1)] if runs and runs[-1][1] == i else [*runs[-1:], (i, i + 1)]
    return runs


def terms(query: str) -> list[str]:
    """Folded query words of two characters and more, each a prefix; other signs than those of words cut a word, and what is
    left of it counts from two characters."""
    long = [w for w in folded(query).split() if len(w) >= 2]
    return [w[a:b] for w in long for a, b in word_runs(w) if b - a >= 2]


def _in_words(text: str) -> bool:
    return all(unicodedata.category(c)[0] in "LMN" for c in text)


def matches(folded: Column, prefixes: list[str]) -> Column:
    """How many words of folded text (as of ``tokens``) begin with one of the prefixes. One pass over the text inside
    code generation; a prefix with other signs than words have begins none."""
    usable = [p for p in prefixes if p and _in_words(p)]
    if not usable:
        return F.lit(0)
    return F.regexp_count(folded, F.lit(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(usable)})"))


def term_rank(folded: Column, prefixes: list[str]) -> Column:
    """Cover density of OR-ed single terms: each matching position is a least cover of one word and adds its weight, a tenth;
    normalised to r / (r + 1)."""
    r = matches(folded, prefixes) * F.lit(0.1)
    return r / (r + 1)


def headline(body: Column | str, prefixes: list[str], most: int = 30, lead: int = 6, least: int = 12) -> Column:
    """A window of at most ``most`` words from ``lead`` words before the first match, or earlier if the text would end
    before ``least`` words; matches in « »."""
    words = F.filter(F.split(_c(body), r"\s+"), lambda w: w != "")
    hits = F.transform(words, lambda w: matches(fold(w), prefixes) > 0)
    first = F.greatest(F.least(F.array_position(hits, True) - lead, F.size(words) - least + 1), F.lit(1)).cast("int")
    marked = F.transform(F.arrays_zip(words.alias("w"), hits.alias("h")), lambda x: F.when(x["h"], F.concat(F.lit("«"), x["w"], F.lit("»"))).otherwise(x["w"]))
    return F.when(F.array_contains(hits, True), F.array_join(F.slice(marked, first, most), " ")).otherwise(F.left(_c(body), F.lit(160)))


def snippet(body: Column | str, folded: Column | str, needle: str, before: int = 60, after: int = 100) -> Column:
    """Raw text around the place of the needle in the folded text, with … where it was cut."""
    raw, at = _c(body), F.locate(needle, _c(folded))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at - 1 + after, F.length(raw))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(raw, start, end - start + 1), F.when(end < F.length(raw), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.left(raw, F.lit(after)))


def clamp_question(col: Column | str, most: int = 1000) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s+", " ")), 1, most)


def session_title(col: Column | str, most: int = 80) -> Column:
    """The first characters of a question, blanks collapsed; null and blank texts have an empty title."""
    return clamp_question(col, most)


def json_contains(col: Column | str, part: dict[str, object]) -> Column:
    """Whether a JSON object holds all of the given members (numbers, texts, booleans); false for what is not JSON."""
    value = F.try_parse_json(_c(col))
    out = F.lit(True)
    for name, want in part.items():
        kind = "boolean" if isinstance(want, bool) else "double" if isinstance(want, int | float) else "string"
        out = out & F.coalesce(F.try_variant_get(value, f"$.{name}", kind) == F.lit(want), F.lit(False))
    return out


def citations(answer: Column | str, code: str = "SB", ref: str = r"\d+(?:\.\d+)*[a-z]?") -> Column:
    """Distinct cited references in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(_c(answer), F.lit(rf"\[{code}\s+({ref})\]"), F.lit(1)))


def ground(answer: Column | str, allowed: Column, code: str = "SB", ref: str = r"\d+(?:\.\d+)*[a-z]?") -> Column:
    """struct(text, refs): disallowed citations cut out, blanks collapsed; an empty text if none is valid."""
    a = _c(answer)
    cited = citations(a, code, ref)
    good, bad = F.array_intersect(cited, allowed), F.array_except(cited, allowed)
    strip = lambda t, r: F.regexp_replace(t, F.concat(F.lit(rf"\[{code}\s+"), F.replace(r, F.lit("."), F.lit(r"\.")), F.lit(r"\]")), F.lit(""))
    text = F.trim(F.regexp_replace(F.aggregate(bad, a, strip), " {2,}", " "))
    return F.struct(F.when(F.size(good) > 0, text).otherwise(F.lit("")).alias("text"), good.alias("refs"))


def parse_tags(col: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(col), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def word_meanings(col: Column | str) -> Column:
    """``word — meaning; …`` as structs; entries with only a hyphen keep an empty meaning, others without a dash go."""
    entries = F.filter(F.transform(F.split(_c(col), ";"), lambda e: F.trim(e)), lambda e: e.contains("—") | e.contains("-"))
    cut = lambda e: F.split(e, "—", 2)
    return F.transform(entries, lambda e: F.struct(F.trim(F.when(e.contains("—"), cut(e)[0]).otherwise(e)).alias("word"), F.trim(F.when(e.contains("—"), F.get(cut(e), F.lit(1))).otherwise(F.lit(""))).alias("meaning")))


def meanings_text(col: Column | str) -> Column:
    return F.array_join(F.transform(_c(col), lambda x: F.concat(x["word"], F.lit(" — "), x["meaning"])), "\n")


def latin_digits(col: Column | str) -> Column:
    return F.translate(_c(col), DIGITS, "0123456789")


def deva_digits(col: Column | str) -> Column:
    return F.translate(_c(col).cast("string"), "0123456789", DIGITS)


def dedupe_key(col: Column | str) -> Column:
    """Text without a trailing number in dandas, blanks collapsed."""
    x = F.regexp_replace(F.coalesce(_c(col), F.lit("")), "[।॥]\\s*[०-९0-9]+\\s*[।॥]\\s*$", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def deterministic_uuid(namespace: str, key: Column | str) -> Column:
    return F.regexp_replace(F.md5(F.concat(F.lit(namespace), _c(key))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def email_error(col: Column | str) -> Column:
    t = F.trim(F.coalesce(_c(col), F.lit("")))
    return F.when(t == "", "empty").when(~t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "invalid")


def error_kind(col: Column | str) -> Column:
    """A small set of kinds for sign-in failures, by the words of the message."""
    m = F.lower(_c(col))
    has = lambda *w: F.greatest(*[m.contains(x).cast("int") for x in (*w, w[0])]) == 1
    return (
        F.when(has("otp_expired") | (has("expired") & has("otp")), "expired")
        .when(has("otp_disabled"), "disabled")
        .when(has("rate", "too many"), "rate")
        .when(has("invalid") & has("otp", "token", "code"), "code")
        .when(has("network", "socket", "failed host", "clientexception", "timed out", "timeout"), "network")
        .otherwise("generic")
    )


def percent_encode(col: Column | str) -> Column:
    """URL path encoding: as url_encode, but blanks are %20 and / ~ stay."""
    x = F.replace(F.url_encode(_c(col)), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(F.replace(x, F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def chapter_title(prefix: str, book: Column | str, chapter: Column | str) -> Column:
    """Source page title; the tenth book lies in two halves, of chapters up to 49 and from 50."""
    b, c = _c(book), _c(chapter)
    half = F.when(b == 10, F.when(c <= 49, "पूर्वार्धः/").otherwise("उत्तरार्धः/")).otherwise("")
    return F.concat(F.lit(f"{prefix}/स्कन्धः "), deva_digits(b), F.lit("/"), half, F.lit("अध्यायः "), deva_digits(c))


def localized(values: Column | str, locale: str, fallback: str = "en") -> Column:
    """From a map of locale to text; the fallback stands in for what is missing."""
    m = _c(values)
    return F.coalesce(F.try_element_at(m, F.lit(locale)), F.try_element_at(m, F.lit(fallback)))


def placeholders(col: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(col), F.lit(r"\{(\w+)"), F.lit(1))))


def strip_markup(col: Column | str) -> Column:
    """Pages to plain text: comments, scripts, styles and tags go, blanks collapse."""
    x = F.regexp_replace(_c(col), r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_present(values: Column | str, preferred: list[str]) -> Column:
    """From a map of author to text: the first preferred one present, else any (least key)."""
    m = _c(values)
    any_ = F.try_element_at(m, F.array_min(F.map_keys(m)))
    return F.coalesce(*[F.try_element_at(m, F.lit(p)) for p in preferred], any_)


def speaker_of(col: Column | str, rules: list[tuple[str, str]], within: int = 120) -> Column:
    """The first rule (substring, speaker) that holds for the beginning of the text."""
    head, out = F.left(_c(col), F.lit(within)), F.lit(None).cast("string")
    for needle, who in reversed(rules):
        out = F.when(head.contains(needle), who).otherwise(out)
    return out


def register_sql(spark: SparkSession) -> None:
    """The same folds, words, query terms and reference keys as temporary SQL functions, for queries in SQL."""
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} text_fold(t STRING) RETURNS STRING RETURN replace(replace(replace(lower(translate(coalesce(t, ''), \"{FOLD_FROM}\", '{FOLD_TO}')), 'sh', 's'), 'ri', 'r'), 'ee', 'i')")
    spark.sql(f"{make} text_clamp(t STRING) RETURNS STRING RETURN substring(trim(regexp_replace(coalesce(t, ''), '\\\\s+', ' ')), 1, 1000)")
    spark.sql(f"{make} text_tokens(folded STRING) RETURNS ARRAY<STRING> RETURN filter(split(folded, '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+'), t -> t <> '')")
    words = "filter(split(text_fold(trim(q)), '\\\\s+'), w -> length(w) >= 2)"
    cut = "filter(split(w, '[^\\\\p{L}\\\\p{M}\\\\p{N}]+'), t -> length(t) >= 2)"
    spark.sql(f"{make} text_terms(q STRING) RETURNS ARRAY<STRING> RETURN flatten(transform({words}, w -> {cut}))")
    numbers = "transform(split(regexp_replace(coalesce(r, ''), '[^0-9.]+$', ''), '[.]'), x -> coalesce(try_cast(x AS INT), 0))"
    suffix = "if(coalesce(r, '') RLIKE '[a-z]$', ascii(right(r, 1)) - 96, 0)"
    spark.sql(f"{make} text_ref_parts(r STRING) RETURNS ARRAY<INT> RETURN concat(slice(concat({numbers}, array_repeat(0, 8)), 1, 8), array({suffix}))")
