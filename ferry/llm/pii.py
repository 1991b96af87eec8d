"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"
#: Code points before and after a span in which context words count.
CONTEXT = 40
#: Spans of kinds beyond the base ones are reported from this score on.
LEAST_SCORE = 0.8
#: Values of one block of a running total, and code points of one block of a text.
BLOCK, TEXT_BLOCK = 256, 1024


@dataclass(frozen=True)
class Kind:
    """``pattern`` runs in time linear in the text: runs are taken whole, and a match
    begins at a run's first character or where the last match ended."""

    name: str
    pattern: str
    guard: str
    check: str
    context: str
    prior: float
    mask: str
    base: bool = True


def luhn(digits: str) -> str:
    """SQL: the digits' Luhn sum is a multiple of ten. Every second digit from the
    right counts double, less nine when above nine."""
    doubled = f"(substr({digits}, i, 1)::int * (1 + (length({digits}) - i) % 2))"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + {doubled} - if({doubled} > 9, 9, 0)) % 10 = 0"


def mod97(code: str) -> str:
    """SQL: the code with its first four characters moved to the end, letters read as
    10 to 35, leaves 1 when divided by 97."""
    turned = f"concat(substr({code}, 5), substr({code}, 1, 4))"
    value = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1)"
    return f"aggregate(sequence(1, length({turned})), 0, (a, i) -> (a * if({value} > 9, 100, 10) + {value}) % 97) = 1"


# ``{m}`` is the match, ``{p}`` the text between it and the one before.
_CARD, _CODE = "regexp_replace({m}, '[ -]', '')", "replace({m}, ' ', '')"
# Characters of an IBAN by country: what follows one (a word, a number, another IBAN) is not part of it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + ")"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", "mail|contact|write|e-mail", 0.85, "[EMAIL]"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", rf"{{m}} rlike '^{_OCTET}(\\.{_OCTET}){{{{3}}}}$'", "address|server|host|ip", 0.8, "[IP]"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9](?:[ -]?[0-9]){12}", f"if(length({_CARD}) between 13 and 19, {luhn(_CARD)}, false)", "card|visa|credit|payment", 0.85, "[CARD]"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "[+][0-9]", "length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15", "call|phone|tel|mobile", 0.8, "[PHONE]"),
    Kind("iban", _IBAN, "[A-Z]{2}[0-9]{2}", mod97(_CODE), "iban|account|bank", 0.85, "[IBAN]", False),
    Kind("secret", "AKIA[0-9A-Z]{16}", "AKIA", r"{p} not rlike '[A-Za-z0-9]\\z'", "key|secret|token|aws", 0.85, "[SECRET]", False),
)

_SPANS = "array<struct<start:long,end:long,score:double>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, step: str, zero: str, level: int = 2) -> str:
    """SQL: for each element of an array of longs, ``zero`` and all elements before it
    taken together by ``step`` (of ``{a}`` and ``{x}``), and at the end that of all.

    Elements are taken in blocks of ``BLOCK``, and the blocks' totals likewise, so the
    arrays that grow by one element stay short and a million values cost a few hundred
    steps each. ``transform(array(x), v -> ...)[0]`` gives a value a name: it is worked
    out once, where a column of a lower projection might be put into the loop.
    """
    v, s, c, a, x = (f"{n}{level}" for n in "vscax")
    taken = step.format(a=f"{a}.at", x=x)
    grown = f"concat({a}.out, array({a}.at))"

    def scan(array: str, start: str, last: str) -> str:
        begin = f"named_struct('at', {start}, 'out', cast(array() as array<bigint>))"
        return f"aggregate({array}, {begin}, ({a}, {x}) -> named_struct('at', {taken}, 'out', {grown}), {a} -> {last.format(a=a)})"

    if level == 0:
        return scan(values, zero, "concat({a}.out, array({a}.at))")
    cuts = f"sequence(0, cast((size({v}) - 1) div {BLOCK} as int))"
    block = f"slice({v}, {c} * {BLOCK} + 1, {BLOCK})"
    totals = f"transform({cuts}, {c} -> aggregate({block}, {zero}, ({a}, {x}) -> {step.format(a=a, x=x)}))"
    starts = running(totals, step, zero, level - 1)
    each = f"flatten(transform({cuts}, {c} -> {scan(block, f'{s}[{c}]', '{a}.out')}))"
    whole = f"transform(array({starts}), {s} -> concat({each}, array({s}[size({s}) - 1])))[0]"
    return f"transform(array({values}), {v} -> if(size({v}) = 0, array({zero}), {whole}))[0]"


def _spans(kind: Kind) -> Column:
    """All spans of one kind. The pieces between the matches and the matches add up to
    the text, so running lengths give the places in code points."""
    pieces, matches = f"pieces_{kind.name}", f"matches_{kind.name}"
    near = f"if(concat(lower(right(x.p, {CONTEXT})), ' ', lower(left(x.n, {CONTEXT}))) rlike {_quoted(kind.context)}, 0.1D, 0D)"
    lengths = f"transform({matches}, (m, i) -> cast(length({pieces}[i]) + length(m) as bigint))"
    found = f"transform({matches}, (m, i) -> named_struct('p', {pieces}[i], 'm', m, 'n', {pieces}[i + 1], 'at', places[i] + length({pieces}[i])))"
    sure = f"filter({found}, x -> {kind.check.format(m='x.m', p='x.p')})"
    spans = f"transform({sure}, x -> named_struct('start', x.at, 'end', x.at + length(x.m), 'score', {kind.prior}D + {near}))"
    return F.expr(f"transform(array({running(lengths, '{a} + {x}', '0L')}), places -> {spans})[0]").cast(_SPANS)


def _found(kind: Kind) -> list[Column]:
    """Matches and the pieces around them; texts that the guard rules out are not searched."""
    none, there = F.array().cast("array<string>"), F.col("body").rlike(kind.guard)
    return [
        F.when(there, F.split("body", kind.pattern, -1)).otherwise(none).alias(f"pieces_{kind.name}"),
        F.when(there, F.regexp_extract_all("body", F.lit(kind.pattern), F.lit(0))).otherwise(none).alias(f"matches_{kind.name}"),
    ]


def find_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``spans``, an array of (kind, start, end, score), to every row.

    ``start`` and ``end`` count code points of the whole text, end exclusive. Base kinds
    are all reported; others from ``LEAST_SCORE`` on. Spans are listed by kind, then
    start. One scan, no shuffle, no Python; the work grows with the length of the text
    and the number of its matches. Null or empty text has no spans; repeated rows stay;
    an empty table gives no rows; only ``carry`` and text are read.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)], body.alias("body"))
    searched = inner.select("*", *[c for k in kinds for c in _found(k)])
    each = searched.select(*inner.columns, *[_spans(k).alias(f"spans_{k.name}") for k in kinds])

    def told(k: Kind) -> Column:
        sure = F.filter(f"spans_{k.name}", lambda s: F.lit(True) if k.base else s.score >= LEAST_SCORE)
        return F.transform(sure, lambda s: F.struct(F.lit(k.name).alias("kind"), s.start.alias("start"), s.end.alias("end"), F.least(s.score, F.lit(1.0)).alias("score")))

    return each.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], F.concat(*[told(k) for k in kinds]).alias("spans"))


def _is(kind: str):
    return lambda s: s.kind == kind


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Digest of ``find_personal_data``: counts by kind and the spans as text."""
    base = [k.name for k in KINDS if k.base]
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return find_personal_data(docs).select(
        "doc_id",
        *[F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(spelled(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same documents with every span replaced by its kind's mark.

    Spans that overlap become one mark, of the kind that starts first. All other text,
    and all other columns but n_chars (recounted), stay as they are.
    """
    columns = docs.columns
    # Under names of their own, no column can clash with what is added.
    numbered = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    marks = F.create_map(*[F.lit(v) for k in KINDS for v in (k.name, k.mask)])
    found = find_personal_data(numbered, carry=tuple(numbered.columns)).withColumn("marks", marks)
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    ends = running("transform(o, s -> s.end)", "greatest({a}, {x})", "0L")
    # A part of the text is cut from the blocks that hold it, not from the text's beginning.
    text_blocks = f"regexp_extract_all(text, '(?s).{{1,{TEXT_BLOCK}}}', 0)"
    part = f"substring(array_join(slice(b, cast({{lo}} div {TEXT_BLOCK} as int) + 1, cast(({{hi}}) div {TEXT_BLOCK} - {{lo}} div {TEXT_BLOCK} as int) + 1), ''), cast({{lo}} % {TEXT_BLOCK} as int) + 1, cast({{hi}} - {{lo}} as int))"
    gap = f"if(s.start > e[i], {part.format(lo='e[i]', hi='s.start')}, '')"
    last = "e[size(e) - 1]"
    tail = part.format(lo=last, hi="cast(length(text) as bigint)")
    marked = f"transform(o, (s, i) -> if(s.start >= e[i], concat({gap}, element_at(marks, s.kind)), ''))"
    body = F.col("text")
    masked = F.expr(f"transform(array({ordered}), o -> transform(array({ends}), e -> transform(array({text_blocks}), b -> concat(array_join({marked}, ''), {tail}))[0])[0])[0]")
    done = found.select("*", F.when(F.size("spans") > 0, masked).otherwise(body).alias("_masked"))
    return done.select(*[F.col("_masked").alias(c) if c == "text" else F.length("_masked").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def report_sql() -> str:
    """The same rows in DuckDB's own regular expressions, straight from the rule. An
    IBAN's match takes in the character before it, which ``lead`` gives back."""
    countries = "|".join(f"({c})[0-9]{{2}}( ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": f"(^|[^A-Za-z0-9])({countries})",
        "secret": "AKIA[0-9A-Z]{16}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    lead = "case when regexp_matches(m, '^[A-Z]') then 0 else 1 end"
    code = f"replace(substr(m, 1 + {lead}), ' ', '')"
    doubled = f"(substr({digits}, i, 1)::int * (1 + (length({digits}) - i) % 2))"
    numbers = f"list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::varchar)"
    checks = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda d: d::hugeint <= 255))",
        "card": f"length({digits}) between 13 and 19 and list_sum(list_transform(range(1, length({digits}) + 1), lambda i: {doubled} - case when {doubled} > 9 then 9 else 0 end)) % 10 = 0",
        "phone": f"length({digits}) between 9 and 15",
        "iban": f"list_reduce(list_prepend(0, list_transform({numbers}, lambda v: v::int)), lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1",
        "secret": "not regexp_matches(p, '[A-Za-z0-9]$')",
    }
    parts = []
    for place, (kind, pattern) in enumerate(patterns.items()):
        pieces, matches = f"regexp_split_to_array(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', 0)"
        parts.append(
            f"select r, {place} as place, '{kind}' as kind, s{' + ' + lead if kind == 'iban' else ''} as s, s + length(m) as e from (select r, unnest({matches}) as m, "
            f"unnest(list_transform({matches}, lambda x, k: {pieces}[k])) as p, unnest(list_transform({matches}, lambda x, k: "
            f"coalesce(list_sum(list_transform({pieces}[1:k], lambda y: length(y))), 0) + coalesce(list_sum(list_transform({matches}[1:k - 1], lambda y: length(y))), 0)))::bigint as s "
            f"from texts where regexp_matches(t, '{pattern}')) where {checks[kind]}"
        )
    spelled = "string_agg(kind || ':' || s || ':' || e, ',' order by place, s)"
    return f"""
        with texts as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
        spans as ({' union all '.join(parts)}),
        told as (select r, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
            {spelled} filter (place < 4) as base, {spelled} as spans from spans group by r)
        select doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in ('email', 'ip', 'card', 'phone'))},
            sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from texts left join told using (r)"""
