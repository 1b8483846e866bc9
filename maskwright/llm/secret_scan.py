"""Secret scan: fixed patterns, and a randomness test battery over other token strings.

A candidate is a run of [A-Za-z0-9+/_-] of 20 characters or more, with up to two = at its end; an = inside a run
parts a name from its value, and each is tested by itself. Its encoding is
inferred (digits, hex, base32, alphanumeric, base64); over that alphabet three tests ask whether it could be uniform
random: chi-squared of the character counts, runs about the middle of the alphabet, and serial correlation of
neighbours. Fisher's method joins the three p-values. Inside each class of length (longer strings give the
tests more power) the Benjamini-Hochberg rule finds those that are not random at a false-discovery rate q;
what is left looks random and is reported. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.quality_rules import let

# fixed patterns of the three base kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",  # - and _ are + and / of the other writing
}
#: Items of a run of a long array that is folded.
RUN = 256
#: Lower bounds of the length classes.
LENGTHS = (20, 32, 64, 128)
KINDS = ("assign", "access", "hex", "rand")
_SPANS = "array<struct<s:int,o:int,e:int>>"


def prefixes(values: F.Column, zero: int, join) -> F.Column:
    """For each of an int array what ``join`` (associative, ``zero`` its neutral) makes of those before it; in runs, so that a
    long array is not copied at each step."""
    ints = "array<int>"

    def fold(v, first):
        step = lambda a, x: F.struct(F.array_append(a["out"], a["at"]).alias("out"), join(a["at"], x).alias("at"))
        return F.aggregate(v, F.struct(F.array().cast(ints).alias("out"), first.cast("int").alias("at")), step, lambda a: a["out"])

    def joined(v):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: F.slice(v, r * RUN + 1, F.lit(RUN)))
        return let(runs, lambda rs: let(fold(F.transform(rs, lambda r: F.aggregate(r, F.lit(zero), join)), F.lit(zero)), lambda firsts: F.flatten(F.transform(rs, lambda r, i: fold(r, F.get(firsts, i))))))

    return let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast(ints)))


def _free(base: F.Column, more: F.Column) -> F.Column:
    """Those of ``more`` that overlap none of ``base``: in the order of starts, no end before reaches in and no start behind lies within."""
    last = 2**31 - 1

    def among(every):
        ends = F.transform(every, lambda x: F.when(x["o"] < 3, x["e"]).otherwise(0))
        starts = F.reverse(F.transform(every, lambda x: F.when(x["o"] < 3, x["s"]).otherwise(last)))
        both = F.struct(every.alias("x"), prefixes(ends, 0, lambda u, v: F.greatest(u, v)).alias("before"), F.reverse(prefixes(starts, last, lambda u, v: F.least(u, v))).alias("behind"))
        return let(both, lambda t: F.filter(t["x"], lambda x, i: (x["o"] == 3) & (F.get(t["before"], i) <= x["s"]) & (F.get(t["behind"], i) >= x["e"])))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), let(F.array_sort(F.concat(base, more)), among)).otherwise(more)


def _spans(text: F.Column, pattern: str, kind: int, least: int, group: int = 0) -> F.Column:
    """Spans (start, kind, end) in code points of the leftmost matches whose ``group`` has ``least`` characters."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def of(x):
        # before match i are the gaps 0..i and the matches 0..i-1
        steps = F.transform(x["w"], lambda w, i: F.length(F.get(x["g"], i)) + F.length(w))
        return let(F.struct(x["w"].alias("w"), x["g"].alias("g"), x["p"].alias("p"), prefixes(steps, 0, lambda u, v: u + v).alias("at")), placed)

    def placed(x):
        each = F.transform(x["w"], lambda w, i: let(F.get(x["at"], i) + F.length(F.get(x["g"], i)), lambda s: F.struct(s.alias("s"), F.lit(kind).alias("o"), (s + F.length(w)).alias("e"))))
        return F.filter(each, lambda m, i: F.length(F.get(x["p"], i)) >= least)

    return F.when(text.rlike(pattern), let(F.struct(whole.alias("w"), gaps.alias("g"), part.alias("p")), of)).otherwise(F.array().cast(_SPANS))


def _upper_tail(z: F.Column) -> F.Column:
    """P(Z > z) of the standard normal: Zelen and Severo's polynomial, error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(value: F.Column) -> F.Column:
    """struct(enc, p): the inferred encoding and the joint p-value under uniform randomness."""
    body = F.regexp_replace(value, "=+$", "")
    has = lambda p: body.rlike(p)
    enc = F.when(has("^[0-9]+$"), "digits").when(has("^[0-9a-f]+$") | has("^[0-9A-F]+$"), "hex").when(has("^[A-Z2-7]+$"), "base32").when(has("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")

    def tested(x):
        alphabet = F.element_at(F.create_map(*[F.lit(y) for pair in ALPHABETS.items() for y in pair]), x["enc"])
        text = F.when(x["enc"] == "hex", F.lower(x["body"])).otherwise(x["body"])
        size = F.when(x["enc"] == "base64", F.lit(64)).otherwise(F.length(alphabet)).cast("double")
        codes = F.transform(F.split(text, ""), lambda c: let(F.instr(alphabet, c) - 1, lambda i: F.when(i > 63, i - 2).otherwise(i)).cast("double"))
        return let(F.struct(codes.alias("c"), size.alias("k")), scored)

    def scored(x):
        c, k = x["c"], x["k"]
        n = F.size(c).cast("double")
        counts = F.transform(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda y: y == v)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v * v) * k / n - n
        df = k - 1
        z1 = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p1 = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z1)))
        steps = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        half = k / 2
        up = F.size(F.filter(c, lambda v: v >= half)).cast("double")
        down = n - up
        runs = 1 + F.size(F.filter(steps, lambda s: (s["a"] >= half) != (s["b"] >= half))).cast("double")
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = F.when(var <= 0, F.lit(1e-9)).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var))))
        avg = (k - 1) / 2
        spread = (k * k - 1) / 12
        serial = F.aggregate(steps, F.lit(0.0), lambda a, s: a + (s["a"] - avg) * (s["b"] - avg)) / (spread * F.sqrt(n - 1))
        p3 = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(serial)))
        fisher = -(F.ln(F.greatest(p1, F.lit(1e-30))) + F.ln(F.greatest(p2, F.lit(1e-30))) + F.ln(F.greatest(p3, F.lit(1e-30))))
        return F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)

    return let(F.struct(enc.alias("enc"), body.alias("body")), lambda x: F.struct(x["enc"].alias("enc"), tested(x).alias("p")))


def _length_class(n: F.Column) -> F.Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 8, 2), _spans(text, ACCESS, 1, 16), _spans(text, HEX, 2, 32))
    found = docs.select("doc_id", text.alias("text"), base.alias("base"), _spans(text, CANDIDATE, 3, 20).alias("more"))
    free = _free(F.col("base"), F.col("more"))
    tests = F.transform(free, lambda m: let(F.substring(F.col("text"), m["s"] + 1, m["e"] - m["s"]), lambda v: F.struct(m.alias("m"), battery(v).alias("t"))))
    return found.select("doc_id", "base", F.when(F.size("more") > 0, tests).otherwise(F.transform(F.array().cast("array<int>"), lambda _: F.struct(F.struct(F.lit(0).alias("s"), F.lit(3).alias("o"), F.lit(0).alias("e")).alias("m"), F.struct(F.lit("").alias("enc"), F.lit(0.0).alias("p")).alias("t")))).alias("tests"))


def discovery_limits(tests: DataFrame, q: float) -> dict[int, float]:
    """Per length class the largest p-value that Benjamini-Hochberg rejects at rate ``q`` (0: none).

    P-values are counted in at most 401 steps of ln p per class, each as its upper end, which can only lower the limit;
    so what reaches the driver has a fixed size.
    """
    step = F.least(F.lit(400), F.floor(-10 * F.ln(F.greatest("p", F.lit(1e-30)))).cast("int"))
    counted = tests.groupBy("cls", step.alias("step")).agg(F.count("*").alias("n")).collect()
    limits = {}
    for cls in {r["cls"] for r in counted}:
        own = sorted(((r["step"], r["n"]) for r in counted if r["cls"] == cls), reverse=True)
        total, so_far, limit = sum(n for _, n in own), 0, 0.0
        for s, n in own:
            so_far += n
            high = 2.718281828459045 ** (-s / 10)
            if high <= q * so_far / total:
                limit = high
        limits[cls] = limit
    return limits


def scan(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_rand.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex,
    rand); base_sha256 hashes the same list of the three base kinds. A candidate of the battery that overlaps
    a base span is left to it. Null or empty texts have no span. Limits of the false-discovery control come
    from the candidates of all rows; rows that repeat are counted each. Other columns are ignored, an empty
    table gives an empty result.
    """
    found = _candidates(docs)
    each = found.select(F.explode("tests").alias("x")).select(_length_class(F.col("x.m.e") - F.col("x.m.s")).alias("cls"), F.col("x.t.p").alias("p"))
    limits = discovery_limits(each, q)
    cls = lambda x: _length_class(x["m"]["e"] - x["m"]["s"])

    def random(x):
        limit = F.lit(0.0)
        for k, v in limits.items():
            limit = F.when(cls(x) == k, F.lit(v)).otherwise(limit)
        return x["t"]["p"] > limit

    rand = F.transform(F.filter("tests", random), lambda x: x["m"])
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), name), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["o"] == k)).cast("long")
    out = found.withColumn("rand", rand)
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "rand")).alias("spans"), F.size("rand").cast("long").alias("n_rand"))
