r"""PII spans by candidate gradient boosting (operator 1; DataFrame functions only).

1. Generators propose overlapping spans with high recall: the four base patterns
   (email, ip, card, phone), the values of all assignments, all long tokens, e-mail
   addresses written out, and grouped numbers. A generator is one pass of the
   regular-expression engine that marks its matches; a span's place follows from
   the lengths of the pieces, summed in groups of ``GROUP``, so that a text with
   very many matches stays linear.
2. Base matches that pass their checks are base spans and always stay. Each other
   candidate has a code of binned features of its format (generator, length, share
   of digits, case, hex digits only, separators) and of the characters around it.
   Codes have at most ``CODES`` values.
3. Gradient-boosted trees are fitted to weak labels that are no features: whether
   the words before the candidate name a credential, a contact or a telephone.
   Ordinary long words, values of other keys and numbers without such a word are
   the negatives. All candidates of all documents count: they are summed by code,
   so the driver sees CODES * 2 * 2 sums at most, whatever the corpus.
4. On the half of the documents that the trees did not see, a threshold a kind is
   calibrated to a precision of ``PRECISION``; it selects the spans that are added,
   with or without such words before them. Of added spans that overlap the better
   scored stays, and none that overlaps a base span.

Offsets are code points, end exclusive. No match can loop over a long run twice:
runs are entered at their start only and repeat possessively.

Nulls and odd rows: null is the empty text; an empty text has no spans; repeated
rows agree; an empty table gives an empty result and no added spans, and so do
tables whose labels are all alike. Further columns are not read; they pass through
``redact`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import staged, table, unused, whole_text

CUT = "\x01"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGNED = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_-]{0,40}+\s{0,3}[=:]\s{0,3}[\x22']?)([^\s\x22',;=:]{6,}+)"
LONG_TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+"
WRITTEN = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]++(?:\s?(?:[\[(]\s?dot\s?[\])]|\.)\s?[a-z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z.])[(]?[0-9]{2,4}+[)]?(?:[\x20./-]{1,2}[0-9]{2,6}+){1,5}(?![0-9A-Za-z])"
#: Base generators, and the others: pattern, what a match becomes, a quick test that a text can hold one, and the kind of its spans.
MARKED = f"{CUT}$0{CUT}"
BASE = {"email": (EMAIL, MARKED, "contains(t, '@')"), "ip": (IP, MARKED, "t rlike '[0-9]'"), "card": (CARD, MARKED, "t rlike '[0-9]'"), "phone": (PHONE, MARKED, "contains(t, '+')")}
MORE = {
    "long": (LONG_TOKEN, MARKED, "true", "secret"), "assigned": (ASSIGNED, f"$1{CUT}$2{CUT}", "t rlike '[=:]'", "secret"),
    "written": (WRITTEN, MARKED, "t rlike '[\\\\[(]'", "contact"), "number": (NUMBER, MARKED, "t rlike '[0-9]'", "number"),
}
KINDS = (*BASE, "secret", "contact", "number")
#: Names before a candidate that label it: positive for spans of the kind.
TELLING = {
    "secret": r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[^A-Za-z0-9]{1,6}$",
    "contact": r"(?i)(?:e-?mail|contact|write|reach)[^\n]{0,12}$", "number": r"(?i)(?:tel|phone|fon|fax|call|mobile)[^\n]{0,12}$",
}
BINS = (4, 6, 4, 3, 2, 3, 4, 2, 3)
CODES = math.prod(BINS)
ROUNDS, DEPTH, RATE, PRECISION, GROUP = 20, 3, 0.3, 0.95, 128

_DIGITS = "regexp_replace({x}, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN (length({d}) - i) % 2 = 1
  THEN CAST(substr({d}, i, 1) AS INT) * 2 - IF(CAST(substr({d}, i, 1) AS INT) > 4, 9, 0)
  ELSE CAST(substr({d}, i, 1) AS INT) END) % 10 = 0"""
_OCTETS = "forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(coalesce(nullif(ltrim('0', p), ''), '0') AS INT) <= 255)"


def _valid(generator: str, x: str) -> str:
    """SQL: whether a match of a base pattern passes its checks."""
    d = _DIGITS.format(x=x)
    return {
        "email": "true",
        "ip": _OCTETS.format(x=x),
        "card": f"CASE WHEN length({d}) BETWEEN 16 AND 19 THEN {_LUHN.format(d=d)} ELSE false END",
        "phone": f"length({d}) BETWEEN 8 AND 15",
    }.get(generator, "false")


def _code(generator: int) -> str:
    """SQL: the code of a candidate x between the pieces before and after."""
    n, d = "length(c.x)", f"length({_DIGITS.format(x='c.x')})"
    parts = (
        f"{generator}",
        f"CASE WHEN {n} < 12 THEN 0 WHEN {n} < 16 THEN 1 WHEN {n} < 20 THEN 2 WHEN {n} < 32 THEN 3 WHEN {n} < 64 THEN 4 ELSE 5 END",
        f"CASE WHEN {d} = 0 THEN 0 WHEN {d} * 5 < {n} THEN 1 WHEN {d} < {n} THEN 2 ELSE 3 END",
        "CASE WHEN NOT c.x rlike '[A-Z]' THEN 0 WHEN NOT c.x rlike '[a-z]' THEN 1 ELSE 2 END",
        "IF(c.x rlike '^[0-9A-Fa-f]+$', 1, 0)",
        "least(2, length(regexp_replace(c.x, r'[^ ().=:/_-]', '')))",
        r"CASE WHEN right(c.before, 1) rlike r'[\x22\x27]' THEN 1 WHEN right(c.before, 1) rlike '[=:]' THEN 2 WHEN right(c.before, 1) rlike '[A-Za-z0-9]' THEN 3 ELSE 0 END",
        "IF(right(c.before, 4) rlike '[=:]', 1, 0)",
        r"CASE WHEN left(c.after, 1) rlike r'[\x22\x27]' THEN 1 WHEN left(c.after, 1) rlike '[A-Za-z0-9_]' THEN 2 ELSE 0 END",
    )
    out = "0"
    for size, part in zip(BINS, parts, strict=True):
        out = f"(({out}) * {size} + ({part}))"
    return f"CAST({out} AS INT)"


def _ends(pieces: str) -> str:
    """SQL: where each piece ends: sums of lengths a group, their running sums, and running sums within each group."""
    groups = f"sequence(0, CAST((size({pieces}) - 1) / {GROUP} AS INT))"
    own = f"transform({groups}, g -> transform(slice({pieces}, g * {GROUP} + 1, {GROUP}), x -> length(x)))"
    sums = "transform(own, g -> aggregate(g, 0, (a, x) -> a + x))"
    starts = f"aggregate({sums}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    within = "slice(aggregate(g, array(start), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, size(g))"
    # names for what is used more than once
    return f"transform(array({own}), own -> transform(array({starts}), starts -> flatten(transform(own, (g, i) -> transform(array(starts[i]), start -> {within})[0])))[0])[0]"


def _found(pieces: str, ends: str, checked: str) -> str:
    """SQL: (s, e, x, before, after) of the marked pieces that pass a check, in order."""
    each = f"transform(sequence(1, size({pieces}) - 1, 2), i -> named_struct('s', {ends}[i - 1], 'e', {ends}[i], 'x', {pieces}[i], 'before', right({pieces}[i - 1], 48), 'after', left({pieces}[i + 1], 1)))"
    some = each if checked == "true" else f"filter({each}, c -> {checked})"
    return f"CASE WHEN size({pieces}) > 1 THEN {some} END"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, fold, base spans b_* (s, e), and of each other generator its candidates c_* (s, e, code, label)."""
    out = docs.select("doc_id", F.translate(whole_text(), CUT, "\x02").alias("t")).withColumn(
        "fold", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int")
    )
    named = {**BASE, **{n: m[:3] for n, m in MORE.items()}}
    for name, (pattern, into, quick) in named.items():
        marked = F.regexp_replace(F.col("t"), pattern, into)
        out = out.withColumn(f"p_{name}", F.when(F.expr(quick), F.split(marked, CUT, -1)).otherwise(F.array().cast("array<string>")))
    # ends are needed, and computed, where there are matches only
    out = out.select("doc_id", "fold", *[f"p_{n}" for n in named], *[F.expr(f"CASE WHEN size(p_{n}) > 1 THEN {_ends(f'p_{n}')} END").alias(f"e_{n}") for n in named])
    spans = [F.expr(f"coalesce(transform({_found(f'p_{n}', f'e_{n}', _valid(n, 'c.x'))}, c -> named_struct('s', c.s, 'e', c.e)), CAST(array() AS array<struct<s:int,e:int>>))").alias(f"b_{n}") for n in BASE]
    more = [
        F.expr(f"""coalesce(transform({_found(f'p_{n}', f'e_{n}', 'true')}, c -> named_struct('s', c.s, 'e', c.e, 'code', {_code(g)}, 'label', IF(c.before rlike r"{TELLING[kind]}", 1, 0))),
          CAST(array() AS array<struct<s:int,e:int,code:int,label:int>>))""").alias(f"c_{n}")
        for g, (n, (*_, kind)) in enumerate(MORE.items())
    ]
    return out.select("doc_id", "fold", *spans, *more)


def contingency(found: DataFrame) -> list[tuple[int, int, int, int]]:
    """(fold, code, positives, negatives) over all candidates of all documents: at most 2 * CODES rows."""
    every = F.concat(*[F.transform(f"c_{n}", lambda c: F.struct(c["code"].alias("code"), c["label"].alias("label"))) for n in MORE])
    sums = found.select("fold", F.explode(every).alias("c")).groupBy("fold", "c.code").agg(
        F.sum("c.label").alias("pos"), F.sum(F.lit(1) - F.col("c.label")).alias("neg")
    )
    return [(r["fold"], r["code"], r["pos"], r["neg"]) for r in sums.collect()]


def unpacked(code: int) -> tuple[int, ...]:
    out = []
    for size in reversed(BINS):
        out.append(code % size)
        code //= size
    return tuple(reversed(out))


def grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> tuple:
    """A regression tree over (features, gradient, curvature): (leaf value,) or (feature, value, equal, other)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f, size in enumerate(BINS):
            for v in range(size):
                gl, hl = sum(r[1] for r in rows if r[0][f] == v), sum(r[2] for r in rows if r[0][f] == v)
                if hl > 1e-3 and h - hl > 1e-3:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, v)
    if best is None:
        return (g / (h + 1),)
    _, f, v = best
    return (f, v, grow([r for r in rows if r[0][f] == v], depth - 1), grow([r for r in rows if r[0][f] != v], depth - 1))


def value(tree: tuple, x: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] == tree[1] else tree[3]
    return tree[0]


def boost(counts: dict[int, tuple[int, int]]) -> list[tuple]:
    """Trees of a logistic boosting over codes with (positives, negatives)."""
    rows = [(unpacked(c), p, n) for c, (p, n) in sorted(counts.items())]
    score, trees = [0.0] * len(rows), []
    for _ in range(ROUNDS if rows else 0):
        grads = []
        for (x, p, n), s in zip(rows, score, strict=True):
            prob = 1 / (1 + math.exp(-max(-30, min(30, s))))
            grads.append((x, p - (p + n) * prob, (p + n) * prob * (1 - prob)))
        trees.append(grow(grads, DEPTH))
        score = [s + RATE * value(trees[-1], x) for s, (x, *_) in zip(score, rows, strict=True)]
    return trees


def thresholds(trees: list[tuple], counts: dict[int, tuple[int, int]]) -> dict[str, float]:
    """For each kind the least score from which the calibration half's candidates reach the precision."""
    kinds = [kind for *_, kind in MORE.values()]
    out = {}
    for kind in TELLING:
        mine = sorted(((sum(RATE * value(t, unpacked(c)) for t in trees), p, n) for c, (p, n) in counts.items() if kinds[unpacked(c)[0]] == kind), reverse=True)
        good = bad = 0
        least = math.inf
        for s, p, n in mine:
            good, bad = good + p, bad + n
            if s > 0 and good >= PRECISION * (good + bad):
                least = s
        out[kind] = least - 1e-9
    return out


def tree_sql(tree: tuple) -> str:
    if len(tree) == 1:
        return repr(float(tree[0]))
    below = math.prod(BINS[tree[0] + 1 :])
    return f"IF(CAST(floor(c.code / {below}) AS INT) % {BINS[tree[0]]} = {tree[1]}, {tree_sql(tree[2])}, {tree_sql(tree[3])})"


def _clear(spans: str, better: str) -> str:
    """SQL: spans sorted by start, without those that a better one overlaps; if any two overlap, two neighbours do."""
    touch = f"exists(sequence(1, size({spans}) - 1), i -> {spans}[i].s < {spans}[i - 1].e)"
    return f"IF(size({spans}) > 1 AND {touch}, filter({spans}, x -> NOT exists({spans}, y -> y.s < x.e AND x.s < y.e AND ({better}))), {spans})"


def find_pii(docs: DataFrame, *, trees: bool = True) -> DataFrame:
    """doc_id, own and spans array<struct<kind, nth, s, e, base, score>> in order of kind and start, of every row; without trees no span is added."""
    found, _ = staged(candidates(docs), "candidates")
    sums = contingency(found) if trees else []
    grown = boost({c: (p, n) for fold, c, p, n in sums if fold == 0})
    least = thresholds(grown, {c: (p, n) for fold, c, p, n in sums if fold == 1})
    score = "CAST(" + (" + ".join(f"{RATE} * {tree_sql(t)}" for t in grown) or "0") + " AS DOUBLE)"
    row = "named_struct('kind', '{k}', 'nth', {n}, 's', c.s, 'e', c.e, 'base', {b}, 'score', {s})"
    base = [f"transform(b_{n}, c -> {row.format(k=n, n=KINDS.index(n), b='true', s='double(1)')})" for n in BASE]
    more = []
    for n, (*_, kind) in MORE.items():
        if least[kind] < math.inf:
            scored = f"transform(c_{n}, c -> {row.format(k=kind, n=KINDS.index(kind), b='false', s=score)})"
            more.append(f"filter({scored}, c -> c.score >= {least[kind]!r})")
    by_start, empty = "(a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE b.e - a.e END", f"slice({base[0]}, 1, 0)"
    out = (
        found.withColumn("own", F.expr(f"concat({', '.join(base)})"))
        .withColumn("more", F.expr(f"array_sort(array_distinct(concat({', '.join([empty, *more])})), {by_start})"))
        .withColumn("more", F.expr(_clear("more", "y.score > x.score OR y.score = x.score AND (y.e - y.s > x.e - x.s OR y.e - y.s = x.e - x.s AND (y.s < x.s OR y.s = x.s AND y.nth < x.nth))")))
        .withColumn("all", F.expr(f"array_sort(concat(own, more), {by_start})"))
        .withColumn("all", F.expr(_clear("all", "y.base AND NOT x.base")))
    )
    order = "(a, b) -> CASE WHEN a.nth <> b.nth THEN a.nth - b.nth WHEN a.s <> b.s THEN a.s - b.s ELSE a.e - b.e END"
    return out.select("doc_id", F.expr(f"array_sort(own, {order})").alias("own"), F.expr(f"array_sort(all, {order})").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; rows are matched by doc_id and text."""
    own, id_, h, found = unused(docs, "own", "id", "h", "spans")
    spans = find_pii(docs.dropDuplicates(["doc_id", "text"]).select(F.struct("doc_id", F.xxhash64(whole_text()).alias("h")).alias("doc_id"), "text"))
    by_start = "array_sort(spans, (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE b.e - a.e END)"
    spans = spans.select(F.col("doc_id.doc_id").alias(id_), F.col("doc_id.h").alias(h), F.expr(by_start).alias(found))
    text = F.expr(f"""aggregate({found}, named_struct('at', 0, 'out', ''), (acc, x) -> IF(x.s < acc.at, acc, named_struct('at', x.e,
        'out', concat(acc.out, substr(text, acc.at + 1, x.s - acc.at), '[', x.kind, ']'))), acc -> concat(acc.out, substr(text, acc.at + 1)))""")
    joined = docs.withColumn(own, F.xxhash64(whole_text())).join(spans, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(h)), "left")
    return joined.withColumn("text", F.when(F.size(found) > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = "array_join(transform({}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(own, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(digest.format("own")), 256).alias("base_sha256"),
        F.expr(digest.format("spans")).alias("spans"),
    )
