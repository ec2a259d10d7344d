"""Row expressions over narrations."""

from pyspark.sql import Column, functions as F

from .. import constants as K


def non_blank(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def strict_utr(narration: Column) -> Column:
    """A reference in the one shape that is never ambiguous, else null."""
    found = F.regexp_extract(F.upper(narration), K.UTR_REGEX, 0)
    return F.when(found != "", found)


def has_any_reference(narration: Column) -> Column:
    return narration.rlike(K.ANY_REFERENCE_REGEX)


def reference_after(narration: Column, label: Column, prefix: Column) -> Column:
    """The 6 to 24 digits after a bank's own label (in capitals), with our prefix, else null."""
    text = F.upper(narration)
    at = F.position(label, text)
    tail = F.ltrim(F.substring(text, at + F.length(label), F.length(text)), F.lit(" :-/#"))
    digits = F.regexp_extract(tail, r"^\d+", 0)
    usable = (label != "") & (at > 0) & F.length(digits).between(K.ALIAS_MIN_DIGITS, K.ALIAS_MAX_DIGITS)
    return F.when(usable, F.concat(F.coalesce(prefix, F.lit("")), digits))


def injection_names(text: Column) -> Column:
    """Names of the instruction-like phrases a text contains."""
    names = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in K.INJECTION_PATTERNS]
    return F.array_compact(F.array(*names))


def neutralise(text: Column) -> Column:
    """The text with line breaks, fences and role tags taken out, at narration length."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t]+", " ")
    bare = F.replace(F.replace(flat, F.lit("```"), F.lit("")), F.lit('"""'), F.lit(""))
    untagged = F.regexp_replace(bare, r"(?i)</?\s*(system|instructions?|prompt)\s*>", "")
    tidy = F.trim(F.regexp_replace(untagged, r"\s{2,}", " "))
    cut = F.concat(F.substring(tidy, 1, K.MAX_NARRATION), F.lit("...[truncated]"))
    return F.when(F.length(tidy) > K.MAX_NARRATION, cut).otherwise(tidy)


def bank_name(narration: Column) -> Column:
    text = F.upper(narration)
    named = [F.when(F.contains(text, F.lit(token)), F.lit(name)) for token, name in K.BANK_NAMES]
    return F.coalesce(*named, F.lit("UNKNOWN"))


def standing_identity(kind: Column, subject: Column, context: Column) -> Column:
    """A name for an exception that outlives its close, null for one-off items."""
    named = []
    for dimension in K.IDENTITY_DIMENSIONS:
        value = context.getItem(dimension)
        named.append(F.when(value != "", F.concat(kind, F.lit(f"::{dimension}="), value)))
    whole = F.concat(kind, F.lit("::"), subject)
    return F.when(kind.isin(*K.STANDING_KINDS), F.coalesce(*named, whole))
