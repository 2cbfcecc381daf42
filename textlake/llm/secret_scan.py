"""Secret scans in SQL functions only: base patterns, and sliding-window entropy over candidate strings.

Offsets are prefix sums over the lengths of matches and of the gaps between them. A candidate is a run of at least WINDOW letters, digits
and +/_=-; its class is hex (only hexadecimal digits) or mixed. A fold slides a window over it, adds one to the entering and takes one
off the leaving character's count, PER counts to a long, and keeps the sum of c * log2(c), from which the window's Shannon entropy follows.
Where windows reach their class's limit, the stretch from the first to the last of them is a span, unless the candidate
matches the allow-list, lacks a digit, or overlaps a base span.

Prefix sums and maxima take as many passes over an array as its size has binary digits, so time is nearly linear in a text's matches and
linear in its length.

Defined results: a null text is an empty text, with no spans. Every row gets a row, repeated or null ids included; extra columns
are ignored by scan() and kept by redact(). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN = 12

WINDOW = 20
#: Characters of candidates; each has a count of BITS bits, PER of them to a long.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS = WINDOW.bit_length()
PER = 63 // BITS
#: Bits a character from which a window is a secret, by class.
LIMITS = {"hex": 3.0, "mixed": 3.7}
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Candidates that are no secrets: placeholders, alphabets, UUIDs, one character class only.
ALLOW = r"(?i:example|placeholder|sample|dummy|abcdefghij|0123456789)|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[A-Za-z+/_=-]*$|^[0-9+/_=-]*$"
REDACTED = "[SECRET]"
KINDS = ("assign", "access", "hex", "entropy")


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(values: str, step: str, back: bool = False) -> str:
    """For every place of an array, step(a, b) folded over all values up to it, or with back from it on; step is associative."""
    here, there = ("q + k < size(acc)", "acc[q + k]") if back else ("q >= k", "acc[q - k]")
    return f"""aggregate(filter(transform(sequence(0, 30), e -> shiftleft(1, e)), k -> k < size({values})), {values},
      (acc, k) -> transform(acc, (v, q) -> case when {here} then {step.format('v', there)} else v end))"""


def _spans(kind: str, pattern: str, keep: str = "true", extra: int | None = None) -> Column:
    """Array of (start, rank, end) of the matches for which keep, over m (the match) and g (group `extra`), holds."""
    p, rank = _quote(pattern), KINDS.index(kind)
    none = "cast(array() as array<struct<start:int,rank:int,end:int,m:string,g:string>>)"
    found = f"named_struct('gap', split(text, {p}, -1), 'm', regexp_extract_all(text, {p}, 0), 'g', regexp_extract_all(text, {p}, {extra or 0}))"
    span = f"named_struct('start', ends[i] - length(m), 'rank', {rank}, 'end', ends[i], 'm', m, 'g', z.g[i])"
    spans = _let("ends", _let("lens", "transform(z.m, (m, i) -> length(z.gap[i]) + length(m))", _scan("lens", "{} + {}")), f"filter(transform(z.m, (m, i) -> {span}), x -> {keep})")
    return F.expr(f"case when text rlike {p} then {_let('z', found, spans)} else {none} end")


def _hot_stretch(limits: dict[str, float]) -> str:
    """SQL over x.m: (first, last) character of the windows whose entropy reaches the limit; first is null if none does."""
    limit = f"case when x.m rlike '^[0-9a-fA-F]+$' then {limits['hex']}D else {limits['mixed']}D end"
    term = lambda c: f"(case when {c} > 1 then {c} * log2({c}) else 0D end)"
    order = f"array({', '.join(str(max(0, SIGNS.find(chr(c)))) for c in range(128))})"
    place = lambda i: f"s.order[ascii(cast(substring(s.b, {i} + 1, 1) as string))]"
    one = lambda at: f"shiftleft(1L, {BITS} * ({at} % {PER}))"
    count = lambda at: f"cast(shiftright(s.n[{at} div {PER}], {BITS} * ({at} % {PER})) & {(1 << BITS) - 1} as int)"
    held = "case when e.go is null then s.s + {0} when e.go = e.come then s.s else s.s + {0} + {1} end".format(f"{term('(e.c + 1)')} - {term('e.c')}", f"{term('(e.d - 1)')} - {term('e.d')}")
    hot = f"i >= {WINDOW - 1} and log2({WINDOW}) - sum / {WINDOW} >= s.limit"
    step = f"""named_struct(
      'n', transform(s.n, (v, k) -> v + case when k = e.come div {PER} then {one('e.come')} else 0L end - case when k = e.go div {PER} then {one('e.go')} else 0L end),
      's', sum,
      'first', case when {hot} then coalesce(s.first, i - {WINDOW - 1}) else s.first end,
      'last', case when {hot} then i + 1 else s.last end,
      'b', s.b, 'limit', s.limit, 'order', s.order)"""
    at = f"named_struct('come', {place('i')}, 'go', case when i >= {WINDOW} then {place(f'(i - {WINDOW})')} end)"
    counts = f"named_struct('come', a.come, 'go', a.go, 'c', {count('a.come')}, 'd', {count('a.go')})"
    return f"""
      aggregate(sequence(0, length(x.m) - 1),
        named_struct('n', array_repeat(0L, {-(-len(SIGNS) // PER)}), 's', 0D, 'first', cast(null as int), 'last', cast(null as int),
                     'b', cast(x.m as binary), 'limit', {limit}, 'order', {order}),
        (s, i) -> {_let('a', at, _let('e', counts, _let('sum', held, step)))},
        s -> named_struct('first', s.first, 'last', s.last))"""


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds _base and _spans, arrays of (start, rank, end) in order, to docs, whose text is made non-null."""
    plain = "transform({0}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end))"
    out = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_found", F.concat(_spans("assign", ASSIGN, f"length(x.g) >= {ASSIGN_MIN}", 2), _spans("access", ACCESS), _spans("hex", HEX)))
    out = out.withColumn("_base", F.sort_array(F.expr(plain.format("_found")))).drop("_found")
    out = out.withColumn("_hot", _spans("entropy", CANDIDATE, f"not x.m rlike {_quote(ALLOW)}"))
    hot = f"transform(_hot, x -> transform(array({_hot_stretch(LIMITS)}), h -> named_struct('start', x.start + h.first, 'rank', 3, 'end', x.start + h.last))[0])"
    out = out.withColumn("_hot", F.when(F.size("_hot") > 0, F.expr(f"filter({hot}, x -> x.start is not null)")).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")))
    # a span starts before another's end and ends after its start: of all base spans up to one the greatest end, of all from it on the least start
    reach = _let("u", "transform(al, x -> case when x.rank < 3 then x.end else 0 end)", _scan("u", "greatest({}, {})"))
    onset = _let("u", "transform(al, x -> case when x.rank < 3 then x.start else 2147483647 end)", _scan("u", "least({}, {})", back=True))
    fresh = "filter(al, (x, i) -> x.rank < 3 or reach[i] <= x.start and onset[i] >= x.end)"
    spans = _let("al", "sort_array(concat(_base, _hot))", _let("reach", reach, _let("onset", onset, fresh)))
    return out.withColumn("_spans", F.when(F.size("_hot") > 0, F.expr(spans)).otherwise(F.col("_base"))).drop("_hot")


def listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.rank], ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    rows = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(_base, x -> x.rank = {KINDS.index(kind)})) as long)").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by REDACTED and n_chars, if there, brought up to date; other texts stay as they are.

    The row travels as one struct beside its text, so its columns may have any names and types.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = with_spans(docs.select(F.struct(*own).alias("row"), "text"))
    # pieces are taken from four bytes a character, where every place is reached at once; a leading sign keeps a byte order mark from being read as one
    piece = "substring(decode(concat(encode('|', 'UTF-32'), substring(b, 4 * {0} + 1, 4 * ({1} - {0}))), 'UTF-32'), 2)"
    until = "(case when i > 0 then ends[i - 1] else 0 end)"
    parts = f"transform(_spans, (x, i) -> case when x.start >= {until} then concat({piece.format(until, 'x.start')}, '{REDACTED}') else '' end)"
    ends = _let("u", "transform(_spans, x -> x.end)", _scan("u", "greatest({}, {})"))
    cut = F.expr(_let("b", "encode(text, 'UTF-32')", _let("ends", ends, f"concat(array_join({parts}, ''), {piece.format('ends[size(ends) - 1]', 'cast(octet_length(b) / 4 as int)')})")))
    rows = rows.select("row", F.when(F.size("_spans") > 0, cut).alias("text"))  # null where nothing changes
    given = lambda c: F.col("row").getField(c)
    new = {"text": F.coalesce("text", given("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(given("n_chars"))
    return rows.select(*(new.get(c, given(c)).alias(c) for c in docs.columns))
