"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

A candidate is a long run of the letters that encoded secrets are written in.  Its encoding is inferred from the
letters it has.  Three statistics are taken of it: chi-squared against equal use of the encoding's alphabet, the number
of runs above and below the alphabet's middle, and serial correlation.  A candidate is random if none of them rejects
randomness.  Whether that says anything depends on its length: the p-value is the chance that written language of that
length comes as near to equal use of letters, and changes as often between small letters, capitals and digits (both
grow with the length, so short ones never get a small p-value), and the Benjamini-Hochberg rule over all candidates of
all documents sets the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, quoted

#: The patterns of the three kinds, in the order that equal starts are listed in.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Candidates of the battery.
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: The chance that two letters of written language are the same.
REPEAT = 0.065
#: How often written names in the letters of each encoding change between small letters, capitals and digits.
TURNS = {"hex": 0.2, "base32": 0.1, "base64": 0.25}
#: Entries of an array, and letters of a text, that are worked on at a time.
BLOCK, LETTERS = 128, 4096
#: Randomness is rejected beyond this many standard deviations; share of false finds among the finds; p-value bins in a power of ten, and powers.
LIMIT, FALSE_SHARE, BINS, POWERS = 3.3, 0.01, 20, 60


def running(values: Column, zero: Column, add) -> Column:
    """For each entry what ``add`` makes of all entries up to it, in time that grows with the power 1.5 of their number."""
    fold = lambda a: F.aggregate(a, zero, add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    spread = let(
        blocks,
        lambda bs: let(
            F.transform(bs, fold),
            lambda sums: F.flatten(F.transform(bs, lambda b, k: let(fold(F.slice(sums, F.lit(1), k)), lambda base: F.transform(b, lambda _, i: add(base, fold(F.slice(b, F.lit(1), i + 1))))))),
        ),
    )
    return F.when(F.size(values) > 0, spread).otherwise(F.slice(values, 1, 0))


def _spans(text: Column, pattern: str, kind: str, rank: int, keep, group: int = 0) -> Column:
    """(start, rank, end, kind, match) of the matches that ``keep`` accepts (by the text of ``group``); code points.

    A match starts where all texts between matches and all matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.zip_with(F.arrays_zip(found.alias("m"), judged.alias("g")), F.split(text, pattern, -1), lambda x, b: F.struct(x["m"].alias("m"), x["g"].alias("g"), (F.length(b) + F.length(x["m"])).alias("n")))
    placed = let(F.filter(rows, lambda x: x["m"].isNotNull()), lambda r: F.zip_with(r, running(F.transform(r, lambda x: x["n"]), F.lit(0), lambda a, b: a + b), lambda x, end: F.struct(
        (end - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.when(keep(x["g"]), x["m"]).alias("match"),
    )))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>")
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: x["match"].isNotNull())).otherwise(none)


def _battery(m: Column) -> Column:
    """(encoding, p) of a candidate; p is null if it isn't random."""
    body = F.regexp_replace(F.regexp_replace(m, "=+$", ""), "[-_]", "+")
    kind = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    out = F.lit(None).cast("double")
    for name, alphabet in ALPHABETS.items():
        out = F.when(kind == name, _tested(F.lower(body) if name == "hex" else body, name, alphabet)).otherwise(out)
    return F.struct(kind.alias("encoding"), out.alias("p"))


def _tested(word: Column, name: str, alphabet: str) -> Column:
    values = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(values, lambda v: _p_value(v, name, len(alphabet)))


def _p_value(v: Column, name: str, k: int) -> Column:
    n = F.size(v).cast("double")
    neighbours = lambda f: F.slice(f, 2, F.greatest(F.lit(1), F.size(f) - 1))
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
    chi = squares * k / n - n
    count = lambda test: F.size(F.filter(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), neighbours(v), lambda a, b: test(a, b)), lambda t: t)).cast("double")
    high = F.size(F.filter(v, lambda x: x >= k // 2)).cast("double")
    mean = 2 * high * (n - high) / n
    runs = F.abs(count(lambda a, b: (a >= k // 2) != (b >= k // 2)) - mean) / F.sqrt(F.greatest(F.lit(0.25), mean * (mean - 1) / (n - 1)))
    middle = (k - 1) / 2
    lag = F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), neighbours(v), lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda s, x: s + x)
    serial = F.abs(lag) / ((k * k - 1) / 12) / F.sqrt(n - 1)
    uniform = (chi - (k - 1)) / (2.0 * (k - 1)) ** 0.5
    # How far from written language: equal use of letters, and changes between small, capital letters and digits.
    extra = n * (k * max(REPEAT, 1.8 / k) - 1)  # of written language's chi-squared, over the mean of k-1
    near = (k - 1 + extra - chi) / F.sqrt(2 * (k - 1 + 2 * extra))
    kind = 10 if name == "hex" else 26
    turns, share = count(lambda a, b: F.floor(a / kind) != F.floor(b / kind)), TURNS[name]
    mixed = (turns - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share))
    # The upper tail of the normal distribution, in the closed form of Karagiannidis and Lioumpas.
    x = F.greatest((near + mixed) / 2**0.5, F.lit(0.01))
    tail = (1 - F.exp(-1.98 * x / 2**0.5)) * F.exp(-x * x / 2) / (1.135 * F.sqrt(F.lit(2 * 3.141592653589793)) * x)
    return F.when((uniform <= LIMIT) & (runs <= LIMIT) & (serial <= LIMIT) & (near > 0), F.greatest(tail, F.lit(10.0**-POWERS)))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, base, random): arrays of (start, rank, end, kind, match) per row, the latter with (encoding, p)."""
    t = F.col("__text")
    # The names of kept columns may be any, so they travel in one struct.
    own = docs.select(F.col(key).alias("__key"), F.struct(*([F.col(c) for c in keep] or [F.lit(0).alias("none")])).alias("__keep"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    assign = _spans(t, ASSIGN, "assign", 0, lambda g: F.length(g) >= LEAST_ASSIGN, 2)
    access = _spans(t, ACCESS, "access", 1, lambda g: F.length(g) >= LEAST_ACCESS)
    hexes = F.when(t.rlike(f"[0-9a-f]{{{LEAST_HEX}}}"), _spans(t, f"[0-9a-f]{{{LEAST_HEX},}}", "hex", 2, lambda g: F.lit(True)))
    random = _spans(t, RANDOM, "random", 3, lambda g: F.lit(True))
    own = own.select("__key", "__keep", assign.alias("a"), access.alias("b"), hexes.alias("c"), random.alias("random"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string>>")
    base = F.array_sort(F.concat(F.coalesce("a", none), F.coalesce("b", none), F.coalesce("c", none)))
    tested = F.transform("random", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), _battery(s["match"]).alias("t")))
    return own.select("__key", "__keep", F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("base"), tested.alias("random"))


def threshold(found: DataFrame) -> float:
    """The Benjamini-Hochberg threshold for the candidates' p-values, on a grid of ``BINS`` steps in a power of ten."""
    p = found.select(F.explode("random").alias("x")).select(F.col("x.t.p").alias("p"))
    step = F.floor(-F.log10("p") * BINS)  # its upper edge is 10 ** -(step / BINS)
    rows = p.groupBy(F.when(F.col("p").isNotNull(), step).alias("step")).agg(F.count("*").alias("n")).collect()  # at most BINS * POWERS + 2
    total, sure, best = sum(r["n"] for r in rows), 0, 0.0
    for r in sorted((r for r in rows if r["step"] is not None), key=lambda r: -r["step"]):
        sure += r["n"]
        if (edge := 10.0 ** -(r["step"] / BINS)) <= FALSE_SHARE * sure / total:
            best = edge
    return best


def all_spans(found: DataFrame) -> DataFrame:
    """(__key, __keep, base, spans): base spans, and all spans in order of start and kind."""
    limit = threshold(found)
    extra = F.transform(F.filter("random", lambda s: F.coalesce(s["t"]["p"] <= limit, F.lit(False))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("__key", "__keep", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by commas; spans adds the
    battery's (kind random) to those of the patterns.  Null and empty texts have none; very long ones are read whole.
    Repeated rows and null keys each get a row.  Other columns are not read.
    """
    done = all_spans(materialize(find(docs, key, text)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return done.select(F.col("__key").alias(key), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of a secret replaced by ``mark``; overlapping spans become one.  All columns and rows stay.

    A null text stays null.
    """
    # Rows are kept whole; a key, too, would be a second copy of each text.
    found = materialize(find(docs, text, text, tuple(docs.columns)).withColumn("__key", F.lit(0)))
    spans = fresh(docs, "spans")
    done = all_spans(found).select("__keep.*", F.col("spans").alias(spans))
    t = F.col(text)

    def cut(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """The letters from ``a`` to ``b``, of the blocks that they lie in."""
            first = F.floor(a / LETTERS).cast("int")
            return F.substring(F.array_join(F.slice(blocks, first + 1, F.floor(F.greatest(b - 1, a) / LETTERS).cast("int") - first + 1), ""), a - first * LETTERS + 1, b - a)

        def joined(ends: Column) -> Column:
            last = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= last(i), F.concat(piece(last(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), piece(F.element_at(ends, -1), F.length(t)))

        return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), joined)

    cleaned = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{LETTERS}}}"), F.lit(0)), cut)
    return done.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(t)).select(*quoted(docs))


def _found_sql(name: str, pattern: str, kind: str, rank: int, group: int, least: int) -> str:
    """SQL for the spans of one kind, by adding up the lengths of what stands before each match."""
    p = pattern.replace("'", "''")
    return f"""{name}_all AS (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}')),
{name}_each AS (SELECT r, m[i] AS match, g[i] AS judged, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_all)),
{name} AS (SELECT r, a::BIGINT AS a, a::BIGINT + length(match) AS z, '{kind}' AS kind, {rank} AS rank, match FROM {name}_each WHERE length(judged) >= {least})"""


def _battery_sql(name: str, alphabet: str) -> str:
    """SQL for the p-values of the candidates of one encoding."""
    k, kind, share = len(alphabet), 10 if name == "hex" else 26, TURNS[name]
    extra = k * max(REPEAT, 1.8 / k) - 1
    pair = lambda test: f"len(list_filter(range(1, len(v)), lambda i: {test}))"
    return f"""v_{name} AS (SELECT r, a, z, list_transform(string_split({'lower(body)' if name == 'hex' else 'body'}, ''), lambda c: strpos('{alphabet}', c) - 1) AS v FROM body WHERE encoding = '{name}'),
s_{name} AS (SELECT *, len(v)::DOUBLE AS n, list_sum(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)) ** 2))::DOUBLE * {k} / len(v) - len(v) AS chi, len(list_filter(v, lambda x: x >= {k // 2}))::DOUBLE AS high,
  {pair(f'(v[i] >= {k // 2}) <> (v[i + 1] >= {k // 2})')} AS changes, {pair(f'v[i] // {kind} <> v[i + 1] // {kind}')} AS turns, coalesce(list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - {(k - 1) / 2}::DOUBLE) * (v[i + 1] - {(k - 1) / 2}::DOUBLE))), 0) AS lag FROM v_{name}),
z_{name} AS (SELECT *, 2 * high * (n - high) / n AS mean, ({k - 1} + n * {extra!r}::DOUBLE - chi) / sqrt(2 * ({k - 1} + 2 * n * {extra!r}::DOUBLE)) AS near, (turns - (n - 1) * {share}::DOUBLE) / sqrt((n - 1) * {share}::DOUBLE * {1 - share!r}::DOUBLE) AS mixed FROM s_{name}),
x_{name} AS (SELECT *, greatest((near + mixed) / sqrt(2::DOUBLE), 0.01::DOUBLE) AS x,
  (chi - {k - 1}) / sqrt(2.0::DOUBLE * {k - 1}) <= {LIMIT} AND abs(changes - mean) / sqrt(greatest(0.25::DOUBLE, mean * (mean - 1) / (n - 1))) <= {LIMIT} AND abs(lag) / ({(k * k - 1) / 12!r}::DOUBLE) / sqrt(n - 1) <= {LIMIT} AND near > 0 AS random FROM z_{name}),
p_{name} AS (SELECT r, a, z, CASE WHEN random THEN greatest((1 - exp(-1.98::DOUBLE * x / sqrt(2::DOUBLE))) * exp(-x * x / 2) / (1.135::DOUBLE * sqrt(2 * pi()) * x), 1e-{POWERS}::DOUBLE) END AS p FROM x_{name})"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_found_sql("assign", ASSIGN, "assign", 0, 2, LEAST_ASSIGN)},
{_found_sql("access", ACCESS, "access", 1, 0, LEAST_ACCESS)},
{_found_sql("hexes", HEX, "hex", 2, 0, LEAST_HEX)},
{_found_sql("candidate", RANDOM, "random", 3, 0, 0)},
body AS (SELECT *, CASE WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(body, '[A-Z2-7]+') THEN 'base32' ELSE 'base64' END AS encoding
  FROM (SELECT *, regexp_replace(regexp_replace(match, '=+$', ''), '[-_]', '+', 'g') AS body FROM candidate)),
{", ".join(_battery_sql(n, a) for n, a in ALPHABETS.items())},
p AS (SELECT *, floor(-log10(p) * {BINS}) AS step FROM ({" UNION ALL ".join(f"SELECT * FROM p_{n}" for n in ALPHABETS)})),
steps AS (SELECT 10.0::DOUBLE ** -(step / {BINS}) AS edge, sum(count(*)) OVER (ORDER BY step DESC) AS sure FROM p WHERE step IS NOT NULL GROUP BY step),
cut AS (SELECT coalesce(max(edge), 0) AS edge FROM steps WHERE edge <= {FALSE_SHARE}::DOUBLE * sure / (SELECT count(*) FROM p)),
base AS (SELECT r, a, z, kind, rank FROM assign UNION ALL SELECT r, a, z, kind, rank FROM access UNION ALL SELECT r, a, z, kind, rank FROM hexes),
spans AS (SELECT * FROM base UNION ALL SELECT r, a, z, 'random', 3 FROM p WHERE p <= (SELECT edge FROM cut)),
out AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN out USING (r)
"""
