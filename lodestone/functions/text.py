"""Text functions as Column expressions: all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of questions, and verbs with the nouns they stand for.
STOPWORDS = (
    "a an and are as at be by does for from how in is it of on or the to was were what when where which who why"
).split()
EXPANSIONS = {"handled": ("handle", "handler"), "handles": ("handle", "handler"), "handling": ("handle", "handler")}

#: The refusal sentence, and what marks an answer as a refusal.
REFUSAL_ANSWER = "I cannot find this in the codebase."
REFUSAL_MARKERS = [
    "cannot find",
    "can't find",
    "not in the codebase",
    "not present",
    "no evidence",
    "insufficient context",
    "do not have enough context",
]
#: Fixed value: what ends a shortened text.
TRUNCATED = "\n...[truncated]"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """`body(value)`, with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case tokens of identifiers and words: cut at case changes and at all but ASCII letters and digits."""
    t = F.regexp_replace(text_or_empty(text), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(t, "[^a-zA-Z0-9]+", " ")), " "), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Tokens of a question: some verbs expanded, stop words dropped unless nothing else is left."""
    known = F.create_map(*[x for verb, nouns in EXPANSIONS.items() for x in (F.lit(verb), F.array(*map(F.lit, (verb, *nouns))))])
    expanded = F.flatten(F.transform(tokenize(text), lambda t: F.coalesce(F.try_element_at(known, t), F.array(t))))

    def useful(tokens: Column) -> Column:
        kept = F.filter(tokens, lambda t: ~t.isin(STOPWORDS))
        return F.when(F.size(kept) > 0, kept).otherwise(tokens)

    return let(expanded, useful)


def word_tokens(text: Column) -> Column:
    """Identifier-like tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))


def chunk_id(filepath: Column, name: Column, start: Column, end: Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", filepath, name, start.cast("string"), end.cast("string")).cast("binary")), F.lit(16))


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fixed(number: Column, places: int) -> Column:
    """A float with a fixed number of places as C's printf writes it: its exact binary value, rounded half to even (Java rounds its shortest decimal half up)."""
    ten = 10**places

    def written(x: Column) -> Column:
        whole = F.floor(x)
        part = x - whole  # exact
        high = part * 134217729.0 - (part * 134217729.0 - part)  # its upper 26 bits, so that both products below are exact
        scaled = part * float(ten)
        rest = (high * float(ten) - scaled) + (part - high) * float(ten)
        low = F.floor(scaled)
        over = (scaled - low - 0.5) + rest  # beyond the half
        up = (over > 0) | ((over == 0) & (low % 2 == 1))
        digits = low + F.when(up, 1).otherwise(0)
        return F.concat((whole + F.when(digits == ten, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((digits % ten).cast("string"), places, "0"))

    wide = number.cast("double")
    sign = F.when(wide.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.abs(wide) < float(1 << 53), F.concat(sign, let(F.abs(wide), written))).when(wide.isNotNull(), F.format_string(f"%.{places}f", wide))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens, cut at 60 characters (which may end in a hyphen then)."""
    cleaned = F.regexp_replace(F.lower(text_or_empty(text)), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(cleaned, "^-+|-+$", ""), F.lit(60))


def repo_name(url: Column) -> Column:
    """Last part of a repository's URL, without `.git`."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"([^/:]+)$", 1), r"\.git$", "")


def limit_text(text: Column, limit: int | None) -> Column:
    """The text cut to a number of characters, with a marker if there is room for one."""
    if limit is None:
        return text
    if limit <= len(TRUNCATED):
        short = F.left(text, F.lit(limit))
    else:
        short = F.concat(F.regexp_replace(F.left(text, F.lit(limit - len(TRUNCATED))), r"(?U)\s+$", ""), F.lit(TRUNCATED))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def is_refusal(answer: Column) -> Column:
    low = F.lower(text_or_empty(answer))
    found = F.lit(False)
    for marker in REFUSAL_MARKERS:
        found = found | low.contains(marker)
    return found


def word_set(text: Column) -> Column:
    """Distinct words (ASCII) of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9_]+"), F.lit(0)))


def shared_words(a: Column, b: Column) -> Column:
    """Share of the words of two sets that both hold; two empty ones are equal."""
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), F.lit(1.0))
        .when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words (ASCII); two empty texts are equal."""
    return shared_words(word_set(a), word_set(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def share(s: Column) -> Column:
        norm = F.sqrt(dot(s["a"], s["a"])) * F.sqrt(dot(s["b"], s["b"]))
        return let(F.struct(norm.alias("n")), lambda x: F.when(x["n"] > 0, dot(s["a"], s["b"]) / x["n"]).otherwise(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def clamp(value: Column) -> Column:
    """A score within [0, 1]; null if it is no number."""
    return let(value.try_cast("double"), lambda number: F.when(F.isnan(number) | number.isNull(), None).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))))


def citations(answer: Column) -> Column:
    """Numbers cited as [n]."""
    return F.transform(F.regexp_extract_all(text_or_empty(answer), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("long"))


def invalid_citations(answer: Column, count: Column) -> Column:
    """Whether an answer cites nothing, or anything but 1 to `count`."""
    return let(citations(answer), lambda c: (F.size(c) == 0) | F.exists(c, lambda n: n.isNull() | (n < 1) | (n > count)))


#: Edges of words of letters and digits of any script.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def required_identifiers(question: Column) -> Column:
    """Words of a question that look like code: with an underscore, or a capital behind a small letter."""
    found = F.regexp_extract_all(text_or_empty(question), F.lit(BEGIN + "[A-Za-z_][A-Za-z0-9_]*" + END), F.lit(0))
    return F.filter(found, lambda t: t.contains("_") | t.rlike("[a-z][A-Z]"))


def missing_identifiers(question: Column, answer: Column) -> Column:
    low = F.lower(text_or_empty(answer))
    return F.filter(required_identifiers(question), lambda t: ~F.contains(low, F.lower(t)))


#: Patterns of what an answer claims to exist in code.
CLAIMS = [
    ("`([^`\\n]+)`", 1),
    (BEGIN + r"([a-zA-Z0-9_]+)\(", 1),
    (BEGIN + "[a-z]+_[a-z0-9_]+" + END, 0),
    (BEGIN + "[a-z]+[A-Z][a-zA-Z0-9]+" + END, 0),
    (BEGIN + "[A-Z][a-z0-9]+[A-Z][a-zA-Z0-9]+" + END, 0),
]


def claims(answer: Column) -> Column:
    """Distinct identifiers that an answer names, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text_or_empty(answer), F.lit(p), F.lit(g)) for p, g in CLAIMS]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, strip), lambda c: F.length(c) > 2)))


def ungrounded_claims(answer: Column, allowed: Column) -> Column:
    """Claims that do not stand in the text of the chunks; none if there are no chunks."""
    return F.when(allowed.isNull(), F.array().cast("array<string>")).otherwise(F.filter(claims(answer), lambda c: ~F.contains(allowed, c)))
