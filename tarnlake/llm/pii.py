"""Operator 2: personal data (DataFrame functions only).

Regular expressions propose spans, checksum and range validators (Luhn, mod 97, part ranges, digit
counts) confirm them, further checks on the value (issuer, public address, top-level domain) and
context words on both sides adjust the score, up or down. The four base kinds keep every confirmed
match, with whatever score; further kinds (iban, national_id, secret) need ``MIN_SCORE``.

A span is (start, end, kind, score) in code points, end exclusive. Places come from splitting a
text at the matches of the same pattern and summing the lengths, so no Python is involved.

Defined results: a null or empty text has no span; repeated rows give repeated results; other
columns are carried through (a column named ``spans`` is replaced); an empty table gives an empty result.
Patterns are possessive, so long runs neither backtrack nor deepen the stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, quoted

MIN_SCORE = 0.5
#: Code points before and behind a span in which context words count.
REACH = 48


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Cheap test that is true for every text with a match.
    hint: str | None
    #: Score of a match that ``valid``, SQL over the matched string ``@v``, confirms.
    score: float
    valid: str
    #: SQL over ``@v`` for values that are likelier than others, and what it adds.
    likely: str = "false"
    likely_score: float = 0.0
    #: Words that add ``context_score`` when found near the span, and words that take ``against_score`` away.
    context: str = ""
    context_score: float = 0.3
    against: str = ""
    against_score: float = 0.3
    base: bool = True


_LUHN = (
    "aggregate(transform(split(reverse(regexp_replace(@v, '[ -]', '')), ''),"
    " (c, i) -> if(c = '', 0, if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)))), 0, (a, y) -> a + y) % 10 = 0"
)
_MOD97 = (
    "aggregate(transform(split(concat(substr(regexp_replace(@v, ' ', ''), 5), substr(@v, 1, 4)), ''),"
    " c -> if(c = '', '', if(c between '0' and '9', c, string(ascii(c) - 55)))), 0L,"
    " (a, y) -> if(y = '', a, (a * if(length(y) = 2, 100, 10) + bigint(y)) % 97)) = 1"
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Addresses that name no host of their own: private, local, reserved.
_RESERVED = r"^0*(?:0|10|127|2(?:2[4-9]|[34][0-9]|5[0-5]))\\.|^0*192\\.0*168\\.|^0*172\\.0*(?:1[6-9]|2[0-9]|3[01])\\.|^0*169\\.0*254\\."

KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6, "true",
         r"@v rlike r'^[A-Za-z0-9].*\.[A-Za-z]{2,24}$' and not @v rlike r'\.\.'", 0.3, r"(?<![a-z])(?:e-?mail|mailto|contact|write|cc|from|to)(?![a-z])", 0.1, r"(?<![a-z])(?:noreply|no-reply|example|placeholder)(?![a-z])", 0.2),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, 0.4, f"@v rlike r'^{_PART}(?:\\.{_PART}){{3}}$'",
         f"not @v rlike '{_RESERVED}'", 0.2, r"(?<![a-z])(?:ip|host|server|address|addr|client|login|from)(?![a-z])", 0.3, r"(?<![a-z])(?:v|ver|version|release|chapter|section|build)(?![a-z])", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", None, 0.4, f"length(regexp_replace(@v, '[ -]', '')) <= 19 and {_LUHN}",
         r"@v rlike r'^(?:4|5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[47]|6[ -]?(?:0|4|5))'", 0.2, r"(?<![a-z])(?:card|visa|mastercard|amex|credit|debit|pan|payment|cvv|cvc)(?![a-z])", 0.3, r"(?<![a-z])(?:isbn|order|invoice|tracking|serial|ticket|reference|ref)(?![a-z])", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "length(regexp_replace(@v, '[^0-9]', '')) between 10 and 15",
         r"@v rlike r'^\+[1-9]' and not @v rlike r'[ ().-]{4}'", 0.2, r"(?<![a-z])(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)(?![a-z])", 0.2, r"(?<![a-z])(?:sum|total|add|equals|score)(?![a-z])", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.55, f"length(regexp_replace(@v, ' ', '')) between 15 and 34 and {_MOD97}",
         "true", 0.0, r"(?<![a-z])(?:iban|account|konto|compte|cuenta|bank|bic|swift|transfer)(?![a-z])", 0.4, r"(?<![a-z])(?:serial|tracking|model|part|sku|licen[cs]e|example)(?![a-z])", 0.2, base=False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "substr(@v, 1, 3) not in ('000', '666') and substr(@v, 1, 1) <> '9' and substr(@v, 5, 2) <> '00' and substr(@v, 8) <> '0000'",
         "true", 0.0, r"(?<![a-z])(?:ssn|social|security|national|id|tax)(?![a-z])", 0.3, r"(?<![a-z])(?:phone|part|order|serial)(?![a-z])", 0.2, base=False),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|passwd|token|secret|api_?key)\x20?[=:]\x20?\"?[A-Za-z0-9_+/.-]{12,}+)", None, 0.6, "true",
         r"@v rlike r'^AKIA' or @v rlike r'[=:].*[0-9]'", 0.2, r"(?<![a-z])(?:key|login|auth|credential|credentials|bearer|aws)(?![a-z])", 0.2, r"(?<![a-z])(?:example|dummy|placeholder|sample|fake)(?![a-z])", 0.4, base=False),
]
BASE = [k.name for k in KINDS if k.base]
_SPAN = "struct<start:int,end:int,kind:string,score:double>"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pii_spans(df: DataFrame, text: str = "text", kinds: list[Kind] | None = None, into: str = "spans") -> DataFrame:
    """Add ``spans`` (or the column named by ``into``): array of (start, end, kind, score), by start and then in the order of ``kinds``."""
    kinds = KINDS if kinds is None else kinds
    keep = [c for c in df.columns if c != into]
    p = free_prefix(df)
    t, every = f"{p}t", f"{p}all"
    d = df.select(*map(quoted, keep), F.coalesce(F.col(quoted(text)), F.lit("")).alias(t))
    none = F.array().cast("array<string>")
    found = {}
    for i, k in enumerate(kinds):
        found[f"{p}m{i}"] = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
        if k.hint:
            found[f"{p}m{i}"] = F.when(F.contains(t, F.lit(k.hint)), found[f"{p}m{i}"]).otherwise(none)
    d = d.withColumns(found)
    d = d.withColumns({f"{p}g{i}": F.when(F.size(f"{p}m{i}") > 0, F.split(t, k.pattern, -1)) for i, k in enumerate(kinds)})
    # Where each match begins: lengths are summed over blocks of matches first, so that
    # a text with very many matches doesn't copy a growing array for each of them.
    d = d.withColumns({f"{p}s{i}": F.expr(_starts(f"{p}m{i}", f"{p}g{i}")) for i in range(len(kinds))})
    d = d.withColumn(every, F.concat(*[F.expr(_spans(p, i, k)) for i, k in enumerate(kinds)]))
    order = "struct(x.start, {0}, x.end, x.kind, x.score)".format("case " + " ".join(f"when x.kind = '{k.name}' then {i}" for i, k in enumerate(kinds)) + " end as rank")
    d = d.withColumn(
        into,
        F.expr(
            f"case when size({every}) = 0 then cast(array() as array<{_SPAN}>) when size({every}) = 1 then {every} else"
            f" transform(array_sort(transform({every}, x -> {order})), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'score', x.score)) end"
        ),
    )
    return d.select(*map(quoted, keep), quoted(into))


def _starts(m: str, g: str, block: int = 128) -> str:
    """SQL for the code-point offsets at which the matches ``m`` between the gaps ``g`` begin."""
    step = f"length({g}[j]) + length({m}[j])"
    within = (
        f"aggregate(sequence(b, least(b + {block}, size({m})) - 1), named_struct('p', 0, 'o', cast(array() as array<int>)),"
        f" (a, j) -> named_struct('p', a.p + {step}, 'o', concat(a.o, array(a.p + length({g}[j])))))"
    )
    return (
        f"case when size({m}) > 0 then aggregate(transform(sequence(0, size({m}) - 1, {block}), b -> {within}),"
        f" named_struct('p', 0, 'o', cast(array() as array<array<int>>)),"
        f" (a, x) -> named_struct('p', a.p + x.p, 'o', concat(a.o, array(transform(x.o, y -> a.p + y)))), a -> flatten(a.o)) end"
    )


def _spans(p: str, i: int, k: Kind) -> str:
    """SQL for the confirmed and scored spans of a kind."""
    m, s, t = f"{p}m{i}", f"{p}s{i}", f"{p}t"
    # The words around a span, with a bar in its place.
    near = f"lower(concat(substr({t}, greatest(x.s - {REACH}, 0) + 1, least(x.s, {REACH})), '|', substr({t}, x.s + length(x.v) + 1, {REACH})))"
    words = [f"if(x.near rlike {_lit(w)}, {sign}{v}D, 0D)" for w, sign, v in ((k.context, "", k.context_score), (k.against, "-", k.against_score)) if w]
    score = " + ".join([f"{k.score}D", f"if({k.likely.replace('@v', 'x.v')}, {k.likely_score}D, 0D)", *words])
    low = "true" if k.base else f"x.score >= {MIN_SCORE}D"
    confirmed = f"filter(transform({m}, (v, n) -> named_struct('s', {s}[n], 'v', v)), x -> {k.valid.replace('@v', 'x.v')})"
    placed = f"transform({confirmed}, x -> named_struct('s', x.s, 'v', x.v, 'near', {near}))"
    return (
        f"case when size({m}) > 0 then filter(transform({placed},"
        f" x -> named_struct('start', x.s, 'end', x.s + length(x.v), 'kind', '{k.name}', 'score', round(least(1D, greatest(0D, {score})), 2))), x -> {low})"
        f" else cast(array() as array<{_SPAN}>) end"
    )


def span_digest(spans: str = "spans", kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    only = "true" if kinds is None else "x.kind in ({})".format(", ".join(f"'{k}'" for k in kinds))
    return F.expr(f"array_join(transform(filter({spans}, x -> {only}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def span_scores(spans: str = "spans") -> Column:
    """The spans' scores in hundredths, comma-joined in their order."""
    return F.expr(f"array_join(transform({spans}, x -> string(int(round(100 * x.score)))), ',')")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in ``text`` by its kind in brackets; overlapping spans are replaced as one.

    Rows without a span, null texts included, stay as they are.
    """
    spans = free_prefix(df) + "spans"
    d = pii_spans(df, text, into=spans)
    masked = F.expr(
        f"case when size({spans}) = 0 then `{text}` else aggregate({spans}, named_struct('p', 0, 'o', ''),"
        f" (a, x) -> named_struct('p', greatest(a.p, x.end), 'o', if(x.start >= a.p, concat(a.o, substr(`{text}`, a.p + 1, x.start - a.p), '[', upper(x.kind), ']'), a.o)),"
        f" a -> concat(a.o, substr(`{text}`, a.p + 1))) end"
    )
    return d.withColumn(text, masked).drop(spans)
