"""Typed literals and identifiers as Column functions; what does not parse is null."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of amount units where a relation declares none, and the mark that may follow a unit.
AMOUNT_UNITS = {"원": 1, "천": 1_000, "만": 10_000, "억": 100_000_000, "조": 1_000_000_000_000}
CURRENCY_MARK = "원"

# The forms of literals.
DATE = r"^([0-9]{4})[.\-/]([0-9]{1,2})(?:[.\-/]([0-9]{1,2}))?$"
DATE_TERM = r"(?i)^date\(\s*([0-9]{4})(?:\s*,\s*([0-9]{1,2})(?:\s*,\s*([0-9]{1,2}))?)?\s*\)$"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
NUMBER_TERM = rf'(?i)^number\(\s*"?({NUMBER})"?\s*\)$'
ORDINAL_COUNTERS = "호|위|번|차|등|째"
ORDINAL_TERM = r"(?i)^ordinal\(\s*([0-9]+)\s*\)$"
AMOUNT = rf"^({NUMBER}) ?(\P{{Nd}}+)$"
AMOUNT_TERM = rf'(?i)^amount\(\s*"?({NUMBER})"?\s*,\s*(?:"([^"]*)"|([^,)"]+))\s*\)$'


def _group(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def parse_date(text: Column) -> Column:
    """yyyymmdd as long of ``2030-1-2``, ``2030.1`` or ``date(2030,1)``; a missing month or day is 1."""
    t = F.trim(text)
    part = lambda k: F.coalesce(_group(t, DATE, k), _group(t, DATE_TERM, k))
    year, month, day = part(1), F.lpad(F.coalesce(part(2), F.lit("1")), 2, "0"), F.lpad(F.coalesce(part(3), F.lit("1")), 2, "0")
    valid = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    return F.when(year.isNotNull() & valid.isNotNull(), F.date_format(valid, "yyyyMMdd").cast("long"))


def _decimal(text: Column) -> Column:
    return F.when(text.rlike(f"^{NUMBER}$"), F.regexp_replace(text, ",", "").try_cast("decimal(30,8)"))


def parse_number_scaled(text: Column) -> Column:
    """A decimal number times 1000, half up, as long."""
    t = F.trim(text)
    return F.round(_decimal(F.coalesce(_group(t, NUMBER_TERM, 1), t)) * 1000, 0).try_cast("long")


def parse_ordinal(text: Column) -> Column:
    """The rank in ``3rd``, ``ordinal(3)``, ``3위`` or ``제3호`` as long."""
    t = F.trim(text)
    return F.coalesce(_group(t, r"(?i)^([0-9]+)\s*(?:st|nd|rd|th)$", 1), _group(t, ORDINAL_TERM, 1), _group(t, rf"^제?([0-9]+)\s*(?:{ORDINAL_COUNTERS})$", 1)).try_cast("long")


def _unit(text: Column) -> Column:
    return F.trim(F.coalesce(_group(text, AMOUNT_TERM, 2), _group(text, AMOUNT_TERM, 3)))


def parse_amount(text: Column, units: Mapping[str, int] | Column | None = None) -> Column:
    """``1,200억`` or ``amount(7,"억")`` in base units, half up, as long; one trailing currency mark is dropped if the unit is not known with it.

    ``units`` is a table of factors, or a Column of one (map of unit to long, null for the default table).
    """
    t = F.trim(text)
    number = F.coalesce(_group(t, AMOUNT_TERM, 1), _group(t, AMOUNT, 1))
    unit = F.coalesce(_unit(t), F.trim(_group(t, AMOUNT, 2)))
    table = F.create_map(*[F.lit(x) for pair in (AMOUNT_UNITS if units is None or isinstance(units, Column) else units).items() for x in pair]).cast("map<string,long>")
    table = F.coalesce(units, table) if isinstance(units, Column) else table
    stem = F.when(F.length(unit) > len(CURRENCY_MARK), F.regexp_replace(unit, f"{CURRENCY_MARK}$", ""))
    factor = F.coalesce(F.try_element_at(table, unit), F.try_element_at(table, stem))
    return F.round(_decimal(number) * factor.cast("decimal(20,0)"), 0).try_cast("long")


def canonical_amount(text: Column) -> Column:
    """``amount(1,000,억)`` as ``amount(1000,"억")``, its unit always quoted; any other text as it is."""
    t = F.trim(text)
    number = F.regexp_replace(_group(t, AMOUNT_TERM, 1), ",", "")
    return F.coalesce(F.when(F.contains(text, F.lit("(")), F.concat(F.lit("amount("), number, F.lit(',"'), _unit(t), F.lit('")'))), text)


#: For each hundredth below 1, the least double that is rounded up from it: its half, or the next where the half goes down.
_HALVES = [h if f"{h:.2f}" == f"{(k + 1) / 100:.2f}" else math.nextafter(h, 2) for k in range(100) for h in [(2 * k + 1) / 200]]


def normalize_confidence(text: Column) -> Column:
    """Two decimals between 0.00 and 1.00, the binary value rounded half to even; 0.50 for what is no number."""
    number = F.trim(text).try_cast("double")
    fine = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.5)).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    below = F.least(F.floor(fine * 100), F.lit(99)).cast("int")
    cents = below + (fine >= F.element_at(F.array(*[F.lit(x) for x in _HALVES]), below + 1)).cast("int")
    return (cents / F.lit(100)).cast("decimal(3,2)").cast("string")


def slug(text: Column, fallback: str = "item") -> Column:
    cut = F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", "-"), F.lit("-"))
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def _plain_letters() -> tuple[str, str]:
    """Characters that decompose to one character and marks, and that character, by Unicode's own tables."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        kept = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(kept) == 1 and kept[0] != c:
            pairs.append((c, kept[0]))
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


_ACCENTED, _PLAIN = _plain_letters()
_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]


def strip_accents(text: Column) -> Column:
    """Letters without their marks."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def fold_digits(text: Column) -> Column:
    """Decimal digits of any script as ASCII digits."""
    return F.translate(text, "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS))


def other_digits(text: Column) -> Column:
    """The distinct decimal digits beyond ASCII, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{Nd}&&[^0-9]]"), F.lit(0)))


def one_line(text: Column) -> Column:
    """Tabs and line breaks as spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\t\r\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029]+", " "))


def cite_key(text: Column) -> Column:
    """Letters, digits and ``_:-`` of a key; all else is dropped."""
    return F.regexp_replace(text, "[^A-Za-z0-9_:-]", "")


def labelled_pmid(text: Column) -> Column:
    """The number after the label PMID in free text."""
    return _group(text, r"(?i)(?<![A-Za-z])PMID\s*:?\s*([0-9]{1,9})(?![0-9])", 1)


def labelled_doi(text: Column) -> Column:
    """The DOI of a line that starts with the label DOI."""
    return F.lower(_group(text, r"(?im)^\s*DOI\s*:\s*(?:https?://(?:dx\.)?doi\.org/)?(10\.[0-9]{4,9}/\S+)\s*$", 1))


def instant(text: Column) -> Column:
    """An ISO time; without a zone it is UTC, in a session of that time zone."""
    return F.try_to_timestamp(F.trim(text))


def iso_date(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def version(text: Column) -> Column:
    """The first three runs of digits as integers."""
    return F.transform(F.slice(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), 1, 3), lambda x: x.cast("int"))


def index_is_complete(index: Column) -> Column:
    """Whether an inverted index (map of word to positions) has each position from 0 on once."""
    places = F.array_sort(F.flatten(F.map_values(index)))
    return (F.size(places) > 0) & (places == F.sequence(F.lit(0), F.size(places) - 1))


def scalar(kind: Column, text: Column, units: Column | None = None) -> Column:
    """The scalar of a literal by its type: date, number, ordinal or amount; null for other types."""
    return F.when(kind == "date", parse_date(text)).when(kind == "number", parse_number_scaled(text)).when(kind == "ordinal", parse_ordinal(text)).when(kind == "amount", parse_amount(text, units))


def has_control(text: Column) -> Column:
    """Whether the text holds characters that a claim must not."""
    return text.rlike(r"[\x00-\x1F]")


def title_key(text: Column) -> Column:
    """A title's words in lower case without markup and accents: letters of the Latin alphabet and digits, single spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\$[^$]*\$", " "), r"\\[A-Za-z]+\*?|[{}]", " ")
    return F.trim(F.regexp_replace(F.lower(strip_accents(plain)), "[^0-9a-z]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of a title key."""
    return F.array_distinct(F.filter(F.split(title_key(text), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def doi(text: Column) -> Column:
    """A bare DOI in lower case."""
    return _group(F.lower(F.trim(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/\S+)$", 1)


def pmid(text: Column) -> Column:
    return _group(F.lower(F.trim(text)), r"^(?:https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:\s*)?([0-9]{1,9})/?$", 1)


def arxiv_id(text: Column) -> Column:
    """Base id, new or old style, without version."""
    t = F.lower(F.trim(text))
    prefix = r"^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/|(?:https?://(?:dx\.)?doi\.org/)?10\.48550/arxiv\.|arxiv:\s*)?"
    return F.coalesce(_group(t, prefix + r"([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?$", 1), _group(t, prefix + r"([a-z\-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:\.pdf)?$", 1))


def year(text: Column) -> Column:
    """The first run of four digits as an integer."""
    return _group(text, r"(?<![0-9])([0-9]{4})(?![0-9])", 1).try_cast("int")


def source_file(source: Column) -> Column:
    """A source without its anchor."""
    return F.substring_index(source, "#", 1)


def restore_abstract(index: Column) -> Column:
    """A text from its inverted index (map of word to positions); the first word by name holds a position."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    good = F.array_sort(F.filter(pairs, lambda x: x["p"] >= 0))
    first = F.filter(good, lambda x, k: (k == 0) | (x["p"] != F.get(good, k - 1)["p"]))
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")


# What stands for further authors, and small words that belong to a family name.
FURTHER_AUTHORS = ("et al", "and others", "others", "")
NAME_PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "lo", "ter", "ten", "bin", "ibn", "abu", "av", "zu")


def surname(name: Column) -> Column:
    """The family name in bare lower-case letters, of ``Family, Given`` and ``Given van der Family`` alike; empty for no name or for further authors."""
    raw = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    small = "|".join(NAME_PARTICLES)
    tail = F.regexp_extract(raw, rf"(?i)^\S+(?: \S+)*?((?: (?:{small})\.*)* \S+)$", 1)
    family = F.when(F.contains(raw, F.lit(",")), F.substring_index(raw, ",", 1)).when(tail != "", tail).otherwise(raw)
    nobody = F.rtrim(F.lower(raw), F.lit(".")).isin(*FURTHER_AUTHORS)
    return F.when(nobody, "").otherwise(F.regexp_replace(F.lower(strip_accents(family)), "[^a-z]", ""))


def humanize(text: Column) -> Column:
    """A compound literal as people write it: ``2030-01`` for ``date(2030,1)``, ``7억`` for ``amount(7,"억")``; any other text as it is."""
    t = F.trim(text)
    year, month, day = (_group(t, DATE_TERM, k) for k in (1, 2, 3))
    date = F.when(parse_date(t).isNotNull(), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    return F.when(year.isNotNull(), F.coalesce(date, text)).otherwise(F.coalesce(F.concat(_group(t, AMOUNT_TERM, 1), _unit(t)), _group(t, NUMBER_TERM, 1), text))


def work_id(text: Column) -> Column:
    """``W123`` of an id or its address, whatever its case; null for zero, leading zeros and all else."""
    return F.concat(F.lit("W"), _group(F.trim(text), r"^(?:https?://(?:api\.)?openalex\.org/(?:works/)?)?/?[Ww]([1-9][0-9]*)/*$", 1))
