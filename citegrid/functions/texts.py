"""Text functions as column expressions: hex literals, identifiers, headings, URLs, licences, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# English function words, which are no identifiers.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "these", "those", "are", "was", "were", "has", "have", "had", "its", "not", "but", "into", "onto",
    "per", "via", "all", "any", "each", "when", "which", "also", "then", "than", "both", "only", "will", "can", "may", "must", "shall", "should", "does", "use",
    "uses", "used", "one", "two",
]
# What may follow a hexadecimal literal's digits.
SUFFIXES = ["", "u", "l", "ul", "lu", "ll", "ull", "llu"]
#: A whole word that ``hex_digits`` takes for a literal, as one pattern: lambdas that match each word of a text cost many times as much.
_LITERAL = (
    r"(?=[0-9A-F])(?<![A-Za-z0-9_'])(?:0[xX][0-9A-Fa-f](?:[0-9A-Fa-f_']*[0-9A-Fa-f])?(?i:" + "|".join(SUFFIXES[:0:-1]) + r")?|(?:[0-9][0-9A-Fa-f_]*|[A-F][0-9A-F_]+)[hH])(?![A-Za-z0-9_'])"
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """Lower-cased A-Z, and runs of blanks as one space."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[ \\t\\n\\r]+", " "))


def hex_tokens(text: Column) -> Column:
    """The words of a text as literals have them: letters, digits, and the separators _ and ' inside."""
    return F.filter(F.split(text, "[^A-Za-z0-9_']+"), lambda w: w.rlike("^[0-9A-F]"))


def hex_digits(token: Column) -> Column:
    """The digits of a token that is a literal of either notation, or null: 0x first, with separators and a suffix after; or h last, with a decimal digit first or capitals."""
    low = ascii_lower(token)
    body = F.regexp_extract(low, "^0x(.*?)[ul]*$", 1)
    prefixed = low.startswith("0x") & body.rlike("^[0-9a-f]") & body.rlike("[0-9a-f]$") & ~body.rlike("[^0-9a-f_']") & F.substr(low, F.length(body) + 3).isin(SUFFIXES)
    before = F.substr(token, F.lit(1), F.length(token) - 1)
    vendor = low.endswith("h") & ~before.contains("'") & before.rlike("^[0-9][0-9A-Fa-f_]*$|^[A-F][0-9A-F_]+$")
    return F.when(prefixed, F.regexp_replace(body, "[_']", "")).when(vendor, F.replace(ascii_lower(before), F.lit("_"), F.lit("")))


def hex_literals(text: Column) -> Column:
    """Literals that begin with 0x as written, without separators and suffixes."""
    found = F.filter(hex_tokens(text), lambda w: ascii_lower(w).startswith("0x") & hex_digits(w).isNotNull())
    return F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, "[uUlL]+$", ""), "[_']", ""))


def hex_value(digits: Column) -> Column:
    """The value of hexadecimal digits, with 0x before them or not, as decimal(20,0); null for more than 64 bits."""
    bare = F.regexp_replace(F.regexp_replace(digits, "^0[xX]", ""), "^0+(?=.)", "")
    return F.when(F.length(bare) <= 16, F.conv(bare, 16, 10).cast("decimal(20,0)"))


def hex_values(text: Column) -> Column:
    """The distinct values of all literals of either notation, in order, as decimal(20,0); larger than 64 bits are left out."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0)), lambda w: F.regexp_replace(w, "^0[xX]|[uUlLhH]+$|[_']", ""))
    values = F.transform(F.transform(digits, lambda d: F.ltrim(d, F.lit("0"))), lambda d: F.when(F.length(d) <= 16, F.conv(F.concat(F.lit("0"), d), 16, 10).cast("decimal(20,0)")))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def camel_words(name: Column) -> Column:
    return F.split(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), " ")


def identifiers(text: Column) -> Column:
    """Distinct lower-cased parts of names, cut at other characters than letters and digits and at camel case: of three characters or more, not begun by a digit, no stop words."""
    # Without other characters than ASCII, lower-casing changes A-Z alone.
    parts = F.lower(F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^\x00-\x7F]", " "))
    return F.array_except(F.regexp_extract_all(parts, F.lit("(?<![a-z0-9])[a-z][a-z0-9]{2,}"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def url_key(url: Column) -> Column:
    """Lower-cased scheme and host, default port and fragment dropped, path and query kept."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    bare = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.concat(scheme, F.lit("://"), bare, F.when(rest == "", "/").otherwise(rest))


# Endings of file names, and units, whose numbers are quantities.
ENDINGS = ["yaml", "yml", "md", "rs", "py", "json", "pdf", "html", "txt", "toml", "lock", "sh", "c", "h"]
UNITS = [
    "Hz", "kHz", "MHz", "GHz", "mV", "uV", "\u00b5V", "mA", "uA", "\u00b5A", "B", "kB", "KB", "MB", "GB", "kiB", "KiB", "MiB", "GiB", "bit", "bits", "byte", "bytes",
    "bps", "kbps", "Kbps", "Mbps", "Gbps", "ms", "us", "ns", "\u00b5s", "ps", "%", "x",
]
#: Units that are names of sections as well, and so need a word in small letters after them, or nothing.
SHORT_UNITS = ["V", "A", "B", "s"]
SLUG_WORDS, SLUG_LENGTH = 12, 64


def message_slug(message: Column) -> Column:
    """The template of a message: msg- and its first words without quoted parts, addresses, paths, file names and numbers; msg-unknown without a word."""
    words = F.split(F.regexp_replace(message, r"(?s)(['\"`])(?:(?!\1).)*\1", " "), r"\s+")
    named = lambda w: F.regexp_extract(F.regexp_replace(w, r"[^A-Za-z0-9_]+$", ""), r"\w\.(\w+)$", 1).isin(ENDINGS)
    plain = F.filter(words, lambda w: ~w.contains("/") & ~w.contains("\\") & ~named(w))
    letters = F.filter(F.flatten(F.transform(plain, lambda w: F.split(F.lower(w), "[^a-z0-9_]+"))), lambda w: w.rlike("[a-z]") & ~w.rlike("^0x[0-9a-f_]+$"))
    parts = F.filter(F.flatten(F.transform(letters, lambda w: F.split(w, "[^a-z]+"))), lambda w: w != "")
    slug = F.rtrim(F.substring(F.array_join(F.slice(parts, 1, SLUG_WORDS), " "), 1, SLUG_LENGTH))
    # A list of one, so that the slug is made once, though it is both compared and used.
    named_ = F.transform(F.array(slug), lambda x: F.when(x == "", "msg-unknown").otherwise(F.concat(F.lit("msg-"), F.translate(x, " ", "-"))))
    return F.element_at(named_, 1)


def section_number(title: Column) -> Column:
    """The number that a section's title begins with, or null: digits or a capital, dotted or not, before a word; after Part, Chapter, Section or Appendix letters too.

    A bare number before a unit is a quantity and no number.
    """
    words = F.split(title, r"\s+")
    first, second, third = (F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in range(3))
    bare = lambda w: F.regexp_replace(w, "[.:]$", "")
    kind = F.initcap(first)
    dotted = lambda w: ~w.rlike(r"[^0-9A-Za-z.]|^\.|\.$|\.\.|\.[0-9]*[A-Za-z]")
    label = bare(second)
    labelled = (third != "") & (label != "") & dotted(label)
    part = (kind == "Part") & labelled & ~label.contains(".")
    named = kind.isin("Chapter", "Section", "Appendix") & labelled
    number = F.regexp_replace(first, r"\.$", "")
    plain = (second != "") & dotted(number) & (number.rlike("^[0-9]+$") | number.rlike("^[A-Z][0-9]+") | number.rlike(r"^[0-9A-Z]\w*\.")) & ~number.rlike("^[0-9]+[A-Za-z]|[a-z]")
    unit = F.regexp_replace(second, "[.,;:)]+$", "")
    short = unit.isin(SHORT_UNITS) & ((third == "") | third.rlike("^[a-z]") | (unit != second))
    quantity = number.rlike("^[0-9]+$") & (unit.isin(UNITS) & ~unit.isin(SHORT_UNITS) | short)
    return F.when(part, F.concat(F.lit("Part "), label)).when(named, label).when(plain & ~quantity, number)


def markdown_key(text: Column) -> Column:
    """A heading or a citation of one as compared: without an anchor at its end, backticks, a leading Section or \u00a7 before a number and closing points; blanks and case folded."""
    shown = F.replace(F.rtrim(F.when(F.rtrim(text).endswith("}"), F.substring_index(text, "{#", 1)).otherwise(text)), F.lit("`"), F.lit(""))
    words = F.filter(F.split(F.lower(shown), r"\s+"), lambda w: w != "")
    words = F.transform(words, lambda w, i: F.when((i == 0) & w.startswith("\u00a7"), F.substr(w, F.lit(2))).otherwise(w))
    words = F.filter(words, lambda w, i: w != "")
    lead = (F.get(words, F.lit(0)) == "section") & F.get(words, F.lit(1)).rlike("^[0-9]")
    words = F.when(lead, F.slice(words, 2, F.size(words))).otherwise(words)
    return F.rtrim(F.rtrim(F.array_join(words, " "), F.lit(".:")))


def overlapping_sections(one: Column, other: Column) -> Column:
    """Whether either dotted number is the other or above it."""
    return (one == other) | one.startswith(F.concat(other, F.lit("."))) | other.startswith(F.concat(one, F.lit(".")))


def corpus_state(disposition: Column) -> Column:
    """What a ledger says of a row before the colon."""
    return F.trim(F.substring_index(disposition, ":", 1))


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as 90s, 15m, 2h or 7d; null for others."""
    n = F.when(text.rlike("^[0-9]{1,18}[smhd]$"), F.regexp_extract(text, "^([0-9]+)", 1)).cast("long")
    unit = F.substring(text, -1, 1)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
