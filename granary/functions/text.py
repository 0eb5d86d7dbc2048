"""Text scalars as Column builders; nothing here needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of routing token sets.
ROUTING_STOP_WORDS = """
the and for that this with from are was were have has had not you your our its their which what when where who how why
should would could can any all some such than then there here into about does did will shall must under over que para
com uma dos das por como mais nao não sobre entre quando onde qual quais seu sua esse essa isso pelo pela está esta são
""".split()

# Words left out of extractive overlap.
EXTRACTIVE_STOP_WORDS = """
the and for that this with from are was were have has had not 但 you your our its their which what when where who how why
shall will would should can could may might must any all some such than then there here into onto upon under over about
que para com uma dos das por como mais nao não sobre entre quando onde qual quais seu sua esse essa
""".split()

# Names of model tiers, cheapest first, and what else they are called.
TIERS = ["micro_slm", "slm", "small", "orchestrator"]
TIER_ALIASES = {"micro": "micro_slm", "microslm": "micro_slm", "micro_slm": "micro_slm", "slm": "slm", "small": "small", "orchestrator": "orchestrator", "llm": "orchestrator", "frontier": "orchestrator", "teacher": "orchestrator"}

WORD = r"[\p{L}\p{N}_×÷]"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}+"), 0)


def token_set(text: Column, stop_words: list[str]) -> Column:
    """Distinct tokens of three characters or more without the stop words."""
    long = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}{{3,}}"), 0)
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, stop_words)))


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0)


def sentences(text: Column) -> Column:
    """Sentences of more than 20 characters, split after . ! ? ; and at line ends, without bullets."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+"), lambda s: F.regexp_replace(s, r"^[ \t•*-]+|[ \t•*-]+$", ""))
    return F.filter(parts, lambda s: F.length(s) > 20)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def example_hash(prompt: Column, completion: Column) -> Column:
    """Identity of a training example: trimmed and lower-cased on both sides."""
    return content_hash(F.concat(F.lower(F.trim(prompt)), F.lit("|"), F.lower(F.trim(completion))))


def hash_bucket(digest: Column, buckets: int = 1000) -> Column:
    """The first eight hex digits, modulo buckets."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_estimate(text: Column) -> Column:
    n = F.size(words(text))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.floor(n * 1.3) + 1, F.floor(F.length(text) / 4))).cast("long")


def truncated(text: Column, limit: int) -> Column:
    """The text, cut at limit with the number of characters left out."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit(" … [+"), (F.length(text) - limit).cast("string"), F.lit(" chars]")))


def as_number(value: Column) -> Column:
    """The number that a string is, not one it contains: currency marks, letters r and thousands commas are dropped."""
    bare = F.regexp_replace(value, r"(?i)[€$£R\s,]|EUR|USD|GBP|BRL", "")
    return F.regexp_extract(bare, r"\A-?\d+(\.\d+)?\z", 0).try_cast("double")


def normalised(text: Column) -> Column:
    """Lower case, accents of Latin letters dropped, runs of white space as one space."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tier_of(name: Column, default: str = "slm") -> Column:
    """Lenient tier name; null where it is unknown."""
    known = F.create_map(*(F.lit(x) for pair in TIER_ALIASES.items() for x in pair))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(F.try_element_at(known, F.translate(F.lower(F.trim(name)), "-", "_")))


def tier_rank(tier: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return F.when(at > 0, at - 1).otherwise(len(TIERS)).cast("int")


def formatted_number(value: Column) -> Column:
    """A cell's number as a person writes it: whole numbers without a point, else six places without trailing zeros."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull() | F.isnan(value), "").when(whole, value.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", ""))


def number_ptbr(x: Column, places: int = 1) -> Column:
    """A number with a decimal comma and without grouping; n/d for null."""
    return F.when(x.isNull(), "n/d").otherwise(F.translate(F.translate(F.format_number(x, places), ",", ""), ".", ","))


def money_ptbr(x: Column, places: int = 0) -> Column:
    """An amount with points between thousands and a decimal comma; n/d for null."""
    return F.when(x.isNull(), "n/d").otherwise(F.concat(F.lit("R$ "), F.translate(F.format_number(x, places), ",.", ".,")))


def percent_ptbr(x: Column, places: int = 1, of: float = 1.0) -> Column:
    """A share of a whole as a percentage; divided once and last, so that a half in the last place is still one when it is rounded."""
    return F.when(x.isNull(), "n/d").otherwise(F.concat(number_ptbr(x * 100 / of, places), F.lit("%")))
