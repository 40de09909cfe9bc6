"""Text operators as Catalyst expressions: no Python runs per row.

The patterns spell out Unicode white space and word characters, because the
JVM's ``\\s`` and ``\\W`` cover ASCII only and would split accented words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import vocab

SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same characters one by one, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"
# Printable ASCII is decided first; most characters then cost a single test.
BLANK = rf"[[^!-~]&&[{SPACE}]]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
WORD = rf"[!-~[^{SPACE}]]+"
SENTENCE_BREAK = rf"(?<=[.!?]){BLANK}+"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Unix line ends, no blanks before them, at most one empty line, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def content_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, each closed by a NUL."""
    closed = [F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]
    return F.substring(F.sha2(F.concat(*closed), 256), 1, 16)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def _first_words(text: Column, n: int) -> Column:
    """The text up to its ``n``-th word; it starts with a word or is empty."""
    return F.regexp_extract(text, rf"^(?:{WORD}{BLANK}+){{0,{n - 1}}}{WORD}", 0)


def _whole_sentences(first: Column, text: Column) -> Column:
    """The sentences that end within ``first``, a head of ``text`` that stops
    after a word; where none does, its words."""
    ended = F.regexp_extract(F.concat(first, F.lit(" ")), rf"(?s)^(.*[.!?]){BLANK}", 1)
    kept = F.when(F.length(first) == F.length(text), first).otherwise(ended)
    return F.when(kept != "", F.regexp_replace(kept, SENTENCE_BREAK, " ")).otherwise(
        F.regexp_replace(first, rf"{BLANK}+", " ")
    )


def sentence_cut(text: Column, max_words: int) -> Column:
    """Leading whole sentences within ``max_words``; else the first words."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return vocab.once(F.struct(trimmed.alias("t"), _first_words(trimmed, max_words).alias("p")), lambda s: _whole_sentences(s["p"], s["t"]))


def limit_words(text: Column, max_words: int) -> Column:
    """``STRUCT<text, cut>``: the text, cut at a sentence when it is too long."""
    def limited(s):
        return vocab.once(F.coalesce(F.length(s["p"]) < F.length(s["t"]), F.lit(False)), lambda too_long: F.struct(
            F.when(too_long, _whole_sentences(s["p"], s["t"])).otherwise(s["given"]).alias("text"), too_long.alias("cut")
        ))

    trimmed = strip(text)
    return vocab.once(F.struct(text.alias("given"), trimmed.alias("t"), _first_words(trimmed, max_words).alias("p")), limited)


def passage_key(passage: Column, length: int | None = 160) -> Column:
    """Key under which two passages count as the same one: the first ``length``
    characters of their words, all of them with None."""
    words = F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}_]+", " "))
    return words if length is None else F.substring(words, 1, length)


# Patterns of several ranges are slow; ``translate`` leaves one range to test: after it
# blanks are " ", and only letters, digits and blanks lie between " " and "z".
_OTHERS = "".join(chr(c) for c in range(128) if chr(c) not in SPACES and not chr(c).isalnum())


def match_norm(text: Column) -> Column:
    """Form in which passages are compared: ASCII letters, digits, single blanks."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    plain = F.translate(lowered, SPACES + _OTHERS, " " * len(SPACES) + "\x7f" * len(_OTHERS))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, " {2,}", " "), "[^ -z]+", " "))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.substring(F.btrim(dashed, F.lit("-")), 1, 60)


def composed(text: Column) -> Column:
    """Canonical composed form (NFC), by the Unicode library Spark's collations
    use; text in ASCII is that already and is not handed over."""
    form = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]"), form).otherwise(text)


def full_slug(text: Column) -> Column:
    """The slug without the length limit, letters and marks of every script kept,
    in composed form: the identity key of an organization."""
    dashed = F.regexp_replace(F.lower(composed(text)), r"[^\p{L}\p{M}\p{N}]+", "-")
    return F.btrim(dashed, F.lit("-"))


_ESCAPE = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"


def decode_escapes(text: Column) -> Column:
    r"""Replace literal ``\uXXXX`` sequences by the characters they name."""
    parts = F.split(text, _ESCAPE, -1)
    escapes = F.regexp_extract_all(text, F.lit(_ESCAPE), F.lit(0))

    def character(escape):
        digits = F.replace(escape, F.lit("\\u"), F.lit(""))
        lone_surrogate = (F.length(digits) == 4) & digits.rlike("^[dD][89a-fA-F]")
        return F.when(lone_surrogate, F.lit("\ufffd")).otherwise(
            F.decode(F.unhex(digits), "UTF-16BE")
        )

    joined = F.zip_with(
        parts, escapes, lambda p, e: F.concat(p, F.coalesce(character(e), F.lit("")))
    )
    return F.when(F.instr(text, "\\u") > 0, F.array_join(joined, "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """House style: escapes decoded, dashes and line breaks to commas, no
    control characters, no doubled blanks or commas.  Null becomes empty."""
    out = decode_escapes(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, "[\u2014\u2013]", ", ")
    out = F.regexp_replace(strip(out), rf"{BLANK}*[\r\n]+{BLANK}*", ", ")
    out = F.regexp_replace(out, CONTROL, "")
    out = F.regexp_replace(out, rf"{BLANK}+", " ")
    out = F.regexp_replace(out, r" +,", ",")
    out = F.regexp_replace(out, r",( *,)+", ",")
    out = F.regexp_replace(out, r"([:;,]) *,", "$1")
    return strip(out)


def has_broken_escapes(text: Column) -> Column:
    """True when the text holds a line break or a control character."""
    return F.coalesce(text, F.lit("")).rlike(r"[\r\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def strip_quotes(text: Column) -> Column:
    """Trim, drop straight double quotes at both ends."""
    return F.btrim(strip(F.coalesce(text, F.lit(""))), F.lit('"'))


def is_pointer(body: Column) -> Column:
    """A short body that only points at an attachment."""
    lowered = F.lower(body)
    named = F.lit(False)
    for phrase in vocab.POINTER_PHRASES:
        named = named | F.contains(lowered, F.lit(phrase))
    return (F.length(body) < vocab.MIN_SUBSTANTIVE_CHARS) & named


def is_usable(body: Column, text: Column) -> Column:
    """Enough text, and not just a pointer to a missing attachment."""
    only_pointer = is_pointer(body) & (F.length(text) == F.length(body))
    return (F.length(text) >= vocab.MIN_SUBSTANTIVE_CHARS) & ~only_pointer


def chunk_bounds(
    text: Column,
    size: int = vocab.CHUNK_CHARS,
    overlap: int = vocab.CHUNK_OVERLAP_CHARS,
) -> Column:
    """``ARRAY<STRUCT<start, stop>>``: overlapping windows of at most ``size``
    characters.  A window that is not the last ends at the last empty line of
    its second half, when there is one."""
    return vocab.once(text, lambda t: _chunk_walk(t, size, overlap))


def _chunk_walk(text: Column, size: int, overlap: int) -> Column:
    n = F.length(text)
    half = size // 2
    # Every step moves forward by at least this much, which bounds the walk.
    stride = max(1, half - overlap)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / stride)).cast("int"))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"), F.lit(False).alias("done"))

    def step(acc, _):
        at = acc["at"]
        stop = F.least(n, at + size)
        low = at + half
        window = F.substring(text, low + 1, stop - low)
        back = F.instr(F.reverse(window), "\n\n")
        cut = low + F.length(window) - back - 1
        ends_at_gap = (stop < n) & (back > 0) & (cut > at)
        stop = F.when(ends_at_gap, cut).otherwise(stop)
        chunk = F.struct(at.cast("int").alias("start"), stop.cast("int").alias("stop"))
        done = stop >= n
        ahead = F.greatest(stop - overlap, at + 1)
        return F.struct(
            F.when(acc["done"] | done, at).otherwise(ahead).cast("int").alias("at"),
            F.when(acc["done"], acc["out"]).otherwise(F.concat(acc["out"], F.array(chunk))).alias("out"),
            (acc["done"] | done).alias("done"),
        )

    walked = F.aggregate(steps, first, step, lambda acc: acc["out"])
    single = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("stop")))
    return F.when(n <= size, single).otherwise(walked)


def phrase_flags(text: Column, n_commenters: Column) -> Column:
    """Quality flags for wording that claims more than the record shows."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    flags = [
        F.when(F.contains(lowered, F.lit(p)), F.lit(f"banned_phrase:{p}"))
        for p in vocab.BANNED_PHRASES
    ]
    thin = n_commenters < vocab.MIN_COMMENTERS_FOR_CONCLUSION
    flags.append(
        F.when(F.contains(lowered, F.lit("consensus")) & thin, F.lit("consensus_below_threshold"))
    )
    return F.array_compact(F.array(*flags))


def plural(count: Column, word: str) -> Column:
    return F.concat(
        count.cast("string"), F.lit(f" {word}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s"))
    )


def position_haystack(display_name, organization, primary_issue, secondary_issue,
                      response_type, gap_tags, summary) -> Column:
    """Lower-cased search text of a position: names, labels and summary."""
    def some(column):
        return F.nullif(column, F.lit(""))

    gaps = F.array_join(F.transform(gap_tags, lambda g: vocab.label(vocab.GAPS, g)), " ")
    return F.lower(F.concat_ws(
        " ",
        some(display_name),
        some(organization),
        vocab.label(vocab.ISSUES, primary_issue),
        vocab.label(vocab.ISSUES, secondary_issue),
        vocab.label(vocab.RESPONSE_TYPES, response_type),
        some(gaps),
        some(summary),
    ))
