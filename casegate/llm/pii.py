"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

DataFrame functions only.  Per kind, ``regexp_extract_all`` gives the proposals, ``split`` by the same
pattern the gaps between them, and running sums of both give positions in code points.  Base kinds
(email, ip, card, phone) are leftmost and non-overlapping; a proposal its validator refuses is dropped
and not tried again.  Added kinds: IBANs confirmed by mod-97, and identity numbers and secrets, which
need a score of ``LEAST_SCORE``.  A span's score is its kind's own, more if one of the kind's context
words stands in the 40 code points before it.

The patterns start at the beginning of a run of their characters, and loops over groups are
possessive: both leave the matches as they are and keep time linear and the stack flat on long runs.

Defined results: a null text is empty and has no spans (redacted, it stays null); null ids and
repeated rows are each returned; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """``needs``: a text without a match of it has no proposal (a cheap test); ``valid``: SQL over
    the proposal ``hit``."""

    name: str
    needs: str
    pattern: str
    valid: str
    score: float
    context: str


#: Validators.
_DIGITS = "regexp_replace(hit, '[^0-9]', '')"
_LUHN = f"length({_DIGITS}) between 13 and 19 and luhn_check({_DIGITS})"
_COUNT = f"length({_DIGITS}) between 9 and 15"
_MOD_97 = """
aggregate(
  split(concat(substring(replace(hit, ' ', ''), 5), substring(replace(hit, ' ', ''), 1, 4)), ''), 0,
  (m, c) -> if(c = '', m, if(c between '0' and '9', (m * 10 + ascii(c) - 48) % 97, (m * 100 + ascii(c) - 55) % 97))
) = 1
"""
_IDENTITY = "hit not rlike '^(000|666|9)' and hit not like '%-00-%' and hit not like '%-0000'"

BASE = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"hit rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$'", 0.6, "ip|address|host|server"),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", _LUHN, 0.7, "card|visa|credit|payment|amex"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _COUNT, 0.6, "phone|call|tel|mobile|fax"),
)
ADDED = (
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _MOD_97, 0.8, "iban|account|bank"),
    Kind("identity", "[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _IDENTITY, 0.3, "ssn|social|security|identity"),
    Kind("secret", "AKIA", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", "true", 0.7, "key|aws|access"),
)
LEAST_SCORE = 0.5
CONTEXT_SCORE = 0.2
CONTEXT_REACH = 40
_SPAN = "struct<kind:string,start:int,end:int,hit:string>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _proposals(kind: Kind) -> str:
    return (
        f"if(text rlike {_literal(kind.needs)}, regexp_extract_all(text, {_literal(kind.pattern)}, 0), "
        f"cast(array() as array<string>)) hits_{kind.name}"
    )


def _placed(kind: Kind) -> str:
    """Valid proposals with their positions: sums run over gaps and hits."""
    hits = f"hits_{kind.name}"
    found = f"named_struct('kind', '{kind.name}', 'start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.hit), 'hit', x.hit)"
    step = (
        "named_struct('at', a.at + length(x.gap) + length(x.hit), "
        f"'found', if({kind.valid.replace('hit', 'x.hit')}, concat(a.found, array({found})), a.found))"
    )
    zipped = f"zip_with(slice(split(text, {_literal(kind.pattern)}, -1), 1, size({hits})), {hits}, (gap, hit) -> struct(gap, hit))"
    return (
        f"if(size({hits}) = 0, cast(array() as array<{_SPAN}>), aggregate({zipped}, "
        f"named_struct('at', 0, 'found', cast(array() as array<{_SPAN}>)), (a, x) -> {step}).found) spans_{kind.name}"
    )


def _scored(kind: Kind, base: bool) -> str:
    # a character more on the far side tells whether a word is whole there
    reach = CONTEXT_REACH + 1
    before = f"if(s.start < {reach}, concat(' ', substring(text, 1, s.start)), substring(text, s.start - {reach} + 1, {reach}))"
    after = f"concat(substring(text, s.end + 1, {reach}), if(length(text) - s.end < {reach}, ' ', ''))"
    word = f"(?:{kind.context})s?"
    near = f"{before} rlike '(?i)[^a-z]{word}(?:[^a-z]|\\\\z)' or {after} rlike '(?i)(?:^|[^a-z]){word}[^a-z]'"
    score = f"{kind.score}D + if({near}, {CONTEXT_SCORE}D, 0D)"
    spans = f"transform(spans_{kind.name}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'hit', s.hit, 'score', {score}))"
    return spans if base else f"filter({spans}, s -> s.score >= {LEAST_SCORE}D)"


def find(docs: DataFrame, keep: Column, text: Column) -> DataFrame:
    """``kept, text, base, added``: spans (kind, start, end, hit, score) by kind as listed, then start.
    ``keep`` is carried through."""
    kinds = (*BASE, *ADDED)
    read = docs.select(keep.alias("kept"), text.cast("string").alias("text"))
    proposed = read.selectExpr("kept", "text", *(_proposals(k) for k in kinds))
    placed = proposed.selectExpr("kept", "text", *(_placed(k) for k in kinds))
    sure = ", ".join(_scored(k, True) for k in BASE)
    more = ", ".join(_scored(k, False) for k in ADDED)
    empty = f"cast(array() as array<{_SPAN[:-1]},score:double>>)"
    return placed.selectExpr(
        "kept", "text", f"if(text is null, {empty}, concat({sure})) base", f"if(text is null, {empty}, concat({more})) added"
    )


def listed(spans: str) -> str:
    """SQL: ``kind:start:end`` of the spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in square brackets; of overlapping spans the first
    names the place, and all of them go.  ``length_col`` is kept right."""
    columns = docs.columns
    found = find(docs, F.struct(*(docs[c] for c in columns if c != text_col)), docs[text_col])
    spans = "array_sort(concat(base, added), (a, b) -> if(a.start != b.start, a.start - b.start, b.end - a.end))"
    step = """
      named_struct('at', greatest(a.at, s.end), 'out',
        if(s.start < a.at, a.out, concat(a.out, substring(text, a.at + 1, s.start - a.at), '[', upper(s.kind), ']')))
    """
    built = f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring(text, a.at + 1)))"
    clean = found.selectExpr("kept", f"if(size(base) + size(added) = 0, text, {built}) text", "size(base) + size(added) > 0 changed")
    result = []
    for c in columns:
        if c == text_col:
            result.append(F.col("text").alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            result.append(F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col(f"kept.`{c}`")).alias(c))
        else:
            result.append(F.col(f"kept.`{c}`").alias(c))
    return clean.select(*result)
