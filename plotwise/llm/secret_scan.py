"""Secrets in texts: known shapes, and runs of characters that look drawn at random.

Everything is column expressions. A regular expression gives the matches of a
text, splitting by it gives what lies between, and running sums of both lengths
give the places.

Known shapes are reported as they are. Other long runs of letters and digits
are tested: from its characters a run's encoding is inferred, and three tests
ask whether it could be ordinary text in that alphabet.

* Chi-squared: how far the counts of the alphabet's characters are from even.
  Text is uneven to an extent that grows with its length; the p-value is the
  chance that text is as even as this.
* Runs: how often the kind of character changes. Text changes it at most half
  as often as random characters do.
* Serial correlation of the characters' places in the alphabet. Without knowing
  anything of a text, every correlation is as likely.

Fisher's method combines the three. The false-discovery rate over all runs of
all texts is held by the step-up rule of Benjamini and Hochberg with weights: a
run's weight is what it could hold in bits, so a long run, for which the tests
are sharp, is given more of the allowance than a short one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

# The known shapes.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")
SHAPES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}

#: Runs that are tested: what may stand in an encoded secret, so many characters at least.
LEAST = 20
RUN = r"(?<![A-Za-z0-9+/_\x01-])[A-Za-z0-9+/_\x01-]{%d,}+={0,2}" % LEAST  # noqa: UP031
_MASK = "\x01"

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: Encodings by what a run consists of, the narrowest first: pattern, alphabet, share of places at which random characters change their kind.
ENCODINGS = {
    "decimal": ("[0-9]+", _DIGITS, 0.5),
    "hex": ("[0-9a-f]+", _DIGITS + "abcdef", 15 / 32),
    "HEX": ("[0-9A-F]+", _DIGITS + "ABCDEF", 15 / 32),
    "base32": ("[A-Z2-7]+", _UPPER + "234567", 39 / 128),
    "base36": ("[0-9a-z]+", _DIGITS + _LOWER, 65 / 162),
    "BASE36": ("[0-9A-Z]+", _DIGITS + _UPPER, 65 / 162),
    "base62": ("[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER, 598 / 961),
    "base64": (".+", _UPPER + _LOWER + _DIGITS + "+/", 661 / 1024),
}
#: The chance that two characters of a text are the same letter; in small alphabets twice that of random ones.
COINCIDENCE = 0.065
_BLOCK = 256
#: Places of the histogram of p-values: hundredths of a power of ten.
_STEP, _FLOOR = 100, 1e-300


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it: within blocks of 256 and over the blocks, so long arrays take no quadratic time."""
    sums = lambda v: F.aggregate(v, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(_BLOCK)), lambda i: sums(F.slice(lengths, i, F.lit(_BLOCK))))

    def joined(found: Column) -> Column:
        starts = sums(F.transform(found, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(found, F.slice(starts, F.lit(1), F.size(found)), lambda b, s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + s)))

    return _let(blocks, joined)


_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _long(text: Column) -> Column:
    return F.length(text).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern, none empty: an array of (start, end, value) in code points, end exclusive."""

    def placed(found: Column, between: Column) -> Column:
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(_long(b).alias("b"), _long(m).alias("m"), m.alias("value")))

        def spans(parts: Column) -> Column:
            starts = _running(F.transform(parts, lambda p: p["b"] + p["m"]))
            return F.zip_with(parts, starts, lambda p, s: F.struct((s + p["b"]).alias("start"), (s + p["b"] + p["m"]).alias("end"), p["value"].alias("value")))

        return _let(steps, spans)

    some = lambda found: F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(_let(F.split(text, pattern, -1), lambda between: placed(found, between)))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _valid(kind: str, value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 1)) >= LEAST_ASSIGNED if kind == "assign" else F.lit(True)


def _masked(text: Column, kind: str) -> Column:
    """text with each valid match of a kind written over, character by character."""
    pattern = SHAPES[kind]
    cover = lambda m: F.when(_valid(kind, m), F.repeat(F.lit(_MASK), F.length(m))).otherwise(m)

    def over(t: Column) -> Column:
        joined = lambda found: F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), F.transform(found, cover), lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")
        return _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, t).otherwise(joined(found)))

    return _let(text, over)


def known_shapes(text: Column) -> Column:
    """An array of (start, end, kind) of the known shapes in a text that isn't null, by start and then kind as listed; kind is its place in KINDS."""

    def of(kind: str) -> Column:
        valid = F.filter(matches(text, SHAPES[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*map(of, SHAPES)))


def candidates(text: Column) -> Column:
    """An array of (start, end, value) of the runs of a text that no known shape touches."""

    def free(plain: Column) -> Column:
        covered = plain
        for kind in SHAPES:
            covered = _masked(covered, kind)
        return F.filter(matches(covered, RUN), lambda s: ~F.contains(s["value"], F.lit(_MASK)))

    return F.when(F.regexp_like(text, F.lit(RUN)), _let(F.translate(text, _MASK, " "), free)).otherwise(F.array().cast(_SPAN))


def upper_tail(z: Column) -> Column:
    """The normal probability of more than z (Abramowitz and Stegun 26.2.17)."""

    def tail(v: Column) -> Column:
        a = F.abs(v)
        t = 1 / (1 + a * 0.2316419)
        value = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.when(v >= 0, value).otherwise(1 - value)

    return _let(z, tail)


def _picked(encoding: Column, values: dict[str, object]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(encoding == name, F.lit(value)) if out is None else out.when(encoding == name, F.lit(value))
    return out


def _kinds_changed(body: Column, encoding: Column) -> Column:
    """How often the kind of character changes: digit, capital, small letter, sign; in decimal numbers, 0-4 and 5-9."""
    halves = F.translate(body, _DIGITS, "LLLLLUUUUU")
    kinds = F.translate(body, _DIGITS + _UPPER + _LOWER + "/", "D" * 10 + "U" * 26 + "L" * 26 + "+")
    one = F.when(encoding == "decimal", halves).otherwise(kinds)
    for k in "DUL":
        one = F.regexp_replace(one, f"{k}+", k)
    return F.length(F.regexp_replace(one, r"\++", "+")) - 1


def randomness(run: Column) -> Column:
    """(encoding, bits, p) of a run: its inferred encoding, what it could hold, and the combined p-value under the assumption that it is text."""
    body = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")

    def tested(s: Column, encoding: Column, alphabet: Column, size: Column) -> Column:
        n = F.length(s).cast("double")
        k = size.cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
        uneven = F.greatest(k * COINCIDENCE, F.lit(2.0)) - 1
        chi = upper_tail((k - 1 + n * uneven - (k / n * squares - n)) / F.sqrt(2 * (k - 1) + 4 * n * uneven))
        rare = _picked(encoding, {e: v[2] / 2 for e, v in ENCODINGS.items()})
        runs = upper_tail((_kinds_changed(s, encoding) - 0.5 - rare * (n - 1)) / F.sqrt((n - 1) * rare * (1 - rare)))
        serial = _let(F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda x: _serial(x, n))
        half = -(F.ln(F.greatest(chi, F.lit(_FLOOR))) + F.ln(F.greatest(runs, F.lit(_FLOOR))) + F.ln(serial))
        p = _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        bits = F.floor(n * F.log2(k)).cast("long")
        return F.struct(encoding.alias("encoding"), bits.alias("bits"), F.least(F.greatest(p, F.lit(_FLOOR)), F.lit(1.0)).alias("p"))

    def inferred(s: Column) -> Column:
        name = None
        for e, (pattern, _, _) in ENCODINGS.items():
            fits = F.regexp_like(s, F.lit(f"^(?:{pattern})$"))
            name = F.when(fits, e) if name is None else name.when(fits, e)
        return _let(name, lambda e: _let(_picked(e, {k: v[1] for k, v in ENCODINGS.items()}), lambda a: tested(s, e, a, F.length(a))))

    return _let(body, inferred)


def _serial(x: Column, n: Column) -> Column:
    """The size of the correlation of neighbours among the places x, 1/n at least; 1 where they are all the same."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)
    size = F.size(x)
    products = total(F.zip_with(F.slice(x, F.lit(1), size - 1), F.slice(x, F.lit(2), size - 1), lambda a, b: a * b))

    def share(s: Column) -> Column:
        mean = s / n
        above = products - mean * (2 * s - F.element_at(x, 1) - F.element_at(x, -1)) + (n - 1) * mean * mean
        spread = total(F.transform(x, lambda v: v * v)) - s * mean
        return F.when(spread > 0, F.least(F.greatest(F.abs(above / spread), 1 / n), F.lit(1.0))).otherwise(1.0)

    return _let(total(x), share)


def _place(p: Column, bits: Column) -> Column:
    return F.floor(-F.log10(p / bits) * _STEP)


def discovery_limit(tested: DataFrame, *, rate: float) -> float | None:
    """The least place of the histogram of weighted p-values that is reported, from rows of (bits, p); None without one.

    Only the counts of the places, of which there are a fixed number at most,
    leave the tasks.
    """
    places = tested.groupBy(_place(F.col("p"), F.col("bits")).alias("place")).agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))
    above = Window.orderBy(F.desc("place"))
    ranked = places.select("place", F.sum("n").over(above).alias("reported"), F.sum("bits").over(Window.partitionBy()).alias("all_bits"))
    # m times the threshold, of weighted p-values: p * mean bits / bits, so m cancels but for the sum of bits.
    good = F.pow(F.lit(10.0), -F.col("place") / F.lit(float(_STEP))) * F.col("all_bits") <= rate * F.col("reported")
    return ranked.where(good).agg(F.min("place")).first()[0]


def scan(docs: DataFrame, *, text: str = "text", columns: list[str] | None = None, rate: float = 0.01) -> DataFrame:
    """The named columns of docs with ``base`` and ``found``: arrays of the spans (start, kind, end) of known shapes and of all secrets, in code points, by start.

    Of all runs that are reported as random, a share of ``rate`` at most is
    expected to be text. Null texts are read as empty. Each row stands for
    itself, so repeated rows are reported each; texts of any length are read
    whole. Empty tables give no rows. Columns are all but the text unless
    named; ``base`` and ``found`` may not be among them.
    """
    columns = [c for c in docs.columns if c != text] if columns is None else columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    runs = F.transform(candidates(body), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), randomness(s["value"]).alias("test")))
    read = cut(docs.select(*[F.col(f"`{c}`") for c in columns], known_shapes(body).alias("base"), runs.alias("__runs")))
    tested = read.where(F.size("__runs") > 0).select(F.explode("__runs.test").alias("t")).select("t.bits", "t.p")
    limit = discovery_limit(tested, rate=rate)
    good = F.filter("__runs", lambda r: _place(r["test"]["p"], r["test"]["bits"]) >= limit) if limit is not None else F.slice("__runs", F.lit(1), F.lit(0))
    random = F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), r["end"].alias("end")))
    return read.select(*[F.col(f"`{c}`") for c in columns], "base", F.array_sort(F.concat("base", random)).alias("found"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, *, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    found = scan(docs, columns=["doc_id"], rate=rate)
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")
    return found.select("doc_id", *[count(n) for n in range(3)], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", filler: str = "*", rate: float = 0.01) -> DataFrame:
    """docs with every character of a secret replaced by ``filler``; nulls stay null."""
    rest = [c for c in docs.columns if c != text]
    found = scan(docs.select("*", F.col(f"`{text}`").alias("__text")), text=text, columns=[*rest, "__text"], rate=rate)
    # What lies between spans; where spans overlap, the later one begins where the earlier ones end.
    ends = F.transform("found", lambda s, i: F.coalesce(F.array_max(F.transform(F.slice("found", F.lit(1), i), lambda b: b["end"])), F.lit(0).cast("long")))
    parts = F.zip_with("found", ends, lambda s, e: F.concat(F.substring(F.col("__text"), e + 1, F.greatest(s["start"] - e, F.lit(0))), F.repeat(F.lit(filler), F.greatest(s["end"] - F.greatest(s["start"], e), F.lit(0)).cast("int"))))
    last = F.coalesce(F.array_max(F.transform("found", lambda s: s["end"])), F.lit(0).cast("long"))
    clean = F.when(F.size("found") > 0, F.concat(F.array_join(parts, ""), F.substring(F.col("__text"), last + 1, F.length("__text")))).otherwise(F.col("__text"))
    return found.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])

