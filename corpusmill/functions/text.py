"""Functions on texts and tokens, as columns.

Divergences: replacement rules run in the order given; blanks are collapsed over the whole text; decoding of numbers
takes no hexadecimal or octal forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+"
# Abbreviations before which a period doesn't end a sentence, and what may follow it.
ABBREVIATIONS = ("Knt", "Serj", "Esq", "viz", "£", "[0-9]+[lsd]")
NEXT_IN_SENTENCE = "[a-z]"
# Paragraphs that are no testimony though they begin like one.
SPEECH_EXCLUSIONS = (
    "^(before|for|in|guilty)",
    "conducted the prosecution",
    r"sworn\.$",
    r"^N\.\ ?B\.?",
    r"^\w+\b(indictment|count)",
    "cross examination",
)
# The three forms of speech (speaker and testimony; question and answer, twice).
TESTIMONY = r"^((mrs?\. )?[a-z']+( [a-z']+)?)(, a [a-z'])?\.(.+)"
QUESTION_ANSWER = r"(Q\.?\ ?)(.*)(- A[.,\ ])(.*)"
ANSWERED = r"(.*)(\?\ -A\.?)(.*)"


def words(text: Column) -> Column:
    """The text's words in lower case: maximal runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def collapse_blanks(text: Column) -> Column:
    """Runs of white space as one space, none at the start."""
    return F.ltrim(F.regexp_replace(text, r"\s+", " "))


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expressions and their replacements, one after the other."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def rules_of(flat: list[str]) -> list[tuple[str, str]]:
    if len(flat) % 2:
        raise ValueError("rules are pairs of a pattern and a replacement")
    return list(zip(flat[::2], flat[1::2]))


def covered_text(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def surrounding(text: Column, begin: Column, end: Column, window: int) -> Column:
    """The span with `window` characters on each side, clipped to the text."""
    start = F.greatest(begin - window, F.lit(0))
    return F.substring(text, start + 1, F.least(end + window, F.length(text)) - start)


def token_term(text: Column, lemma: Column | None = None, pos_group: Column | None = None) -> Column:
    """The indexed term: lemma or text in lower case, after the class if one is given."""
    term = F.lower(F.coalesce(lemma, text) if lemma is not None else text)
    return term if pos_group is None else F.concat(pos_group, F.lit("_"), term)


def is_abbreviation(token: Column, extra: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """The first pattern is held at the token's start and the last one at its end, the others nowhere."""
    return F.coalesce(token.rlike(f"^{'|'.join(extra)}$"), F.lit(False))


def ends_no_sentence(before: Column, period: Column, after: Column) -> Column:
    """YES or NO for a period followed by a single lower-case letter: whether an abbreviation stands before it; null
    for other tokens."""
    found = period.rlike(r"^\.$") & after.rlike(rf"\A(?:{NEXT_IN_SENTENCE})\z")
    return F.when(found, F.when(is_abbreviation(before), "YES").otherwise("NO"))


def speech_kind(text: Column) -> Column:
    """testimony, question, answered or none, by the first form that matches; exclusions are looked for in the
    lower-case text and hold for testimonies only."""
    excluded = F.lit(False)
    for p in SPEECH_EXCLUSIONS:
        excluded = excluded | F.lower(text).rlike(p)
    return (
        F.when(F.lower(text).rlike(TESTIMONY) & ~excluded, "testimony")
        .when(text.rlike(QUESTION_ANSWER), "question")
        .when(text.rlike(ANSWERED), "answered")
        .otherwise("none")
    )


def speaker(text: Column) -> Column:
    """Who speaks in a testimony; empty otherwise."""
    return F.when(speech_kind(text) == "testimony", F.regexp_extract(F.lower(text), TESTIMONY, 1)).otherwise("")


def speech_parts(text: Column, offset: Column | None = None) -> Column:
    """What is said and by whom, as (part, begin, end): prefix, speaker, descriptor and testimony, or question and
    answer; parts that are empty or not there are left out. offset: where the text begins in its document."""
    base = F.lit(0) if offset is None else offset
    kind = speech_kind(text)
    part = lambda name, begin, size: F.struct(F.lit(name).alias("part"), (base + begin).cast("int").alias("begin"), (base + begin + size).cast("int").alias("end"))
    group = lambda source, pattern, k: F.regexp_extract(source, pattern, k)
    size = lambda source, pattern, k: F.length(group(source, pattern, k))
    low = F.lower(text)
    named, told = size(low, TESTIMONY, 1), size(low, TESTIMONY, 5)
    testimony = (
        part("prefix", F.lit(0), size(low, TESTIMONY, 2)),
        part("speaker", F.lit(0), named),
        part("descriptor", named, size(low, TESTIMONY, 4)),
        part("testimony", size(low, TESTIMONY, 0) - told, told),
    )

    def asked(pattern: str, question: int, answer: int) -> tuple[Column, ...]:
        first = F.instr(text, group(text, pattern, 0)) - 1
        before = F.lit(0)
        for k in range(1, question):
            before = before + size(text, pattern, k)
        return part("question", first + before, size(text, pattern, question)), part("answer", first + size(text, pattern, 0) - size(text, pattern, answer), size(text, pattern, answer))

    found = F.when(kind == "testimony", F.array(*testimony)).when(kind == "question", F.array(*asked(QUESTION_ANSWER, 2, 4))).when(kind == "answered", F.array(*asked(ANSWERED, 1, 3)))
    return F.filter(found, lambda x: x["end"] > x["begin"])


def verbatim(text: Column, line_end: Column | None = None) -> Column:
    """The text as it stands, with a line end where line_end holds."""
    return text if line_end is None else F.concat(text, F.when(line_end, "\n").otherwise(""))


def readable_size(n: Column) -> Column:
    """A number of bytes in the largest of B, KB, MB, GB, TB that leaves at least one, in steps of 1024; null for null."""
    out = F.format_string("%.2f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", n / 1024.0**power)).otherwise(out)
    return F.when(n.isNotNull(), out)


def base_name(path: Column) -> Column:
    """A file's name up to its last dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def decode(value: Column, kind: str) -> Column:
    """A string as STRING, BYTE, INTEGER, LONG, FLOAT, DOUBLE, BOOLEAN or CHAR; null where it isn't one."""
    kinds = {"STRING": "string", "BYTE": "tinyint", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "REAL": "double", "BOOLEAN": "boolean"}
    return F.substring(value, 1, 1) if kind == "CHAR" else value.try_cast(kinds[kind])
