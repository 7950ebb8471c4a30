"""Secret scans: base patterns, and character Markov models.

Base spans come from three patterns. For other strings two first-order Markov
models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a string is a secret where the log-likelihood ratio between
them, in all and for each character, is high enough. Such spans have the kind
``random`` and are added where no base span lies.

Everything is DataFrame functions. A text is matched where a cheap test finds a
sign of the pattern; offsets come from the lengths of the pieces between
matches. What training brings to the driver is a table of pairs of characters,
of fixed size whatever the samples.

Spans are in code points, end exclusive. Defined results: null or empty text has
no spans; one row out for each row in, null and repeated ids included. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<start:int,kind:int,end:int>>"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A string for the models: a run of these of at least LEAST characters.
STRING = r"[A-Za-z0-9+/_=-]+"
LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The ratio that makes a string a secret: in all, and for each character.
TOTAL, EACH = 12.0, 0.55
#: Parts of identifiers from which labelled samples are made (fixed values).
PARTS = """
get set user name list item index value count total data file path node tree graph edge key map array string number
time date start end first last next prev parent child source target input output read write load save open close
server client request response session config option default error message event handler manager service factory
""".split()


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's matches that ``keep`` (given a match) holds for."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), _no_spans().alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["n"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).cast(SPANS)
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(lengths, zero, step, lambda s: s["spans"])


def base_spans(text: Column) -> Column:
    """Base spans, by start, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    some = [
        F.when(F.rlike(text, F.lit(r"(?i:passw|secret|token|api_?key)")), _matches(text, ASSIGN, 0, value)),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1, lambda m: F.length(m) >= 20)),
        # runs too short to keep need not be matched: what is left is the same
        F.when(F.rlike(text, F.lit("[0-9a-f]{24}")), _matches(text, r"[0-9a-f]{24,}", 2, lambda m: F.lit(True))),
    ]
    return F.array_sort(F.concat(*[F.coalesce(x, _no_spans()) for x in some]))


def labelled_samples(spark: SparkSession, n: int = 4096) -> DataFrame:
    """(string, random): ``n`` strings of each kind. Random ones are digests in
    three alphabets, ordinary ones parts joined in three styles."""
    ids = spark.range(n).select("id", *[F.sha2(F.concat_ws("-", F.lit(x), F.col("id").cast("string")), 256).alias(f"h{x}") for x in range(2)])
    encoded = F.base64(F.unhex("h0"))
    mixed = F.concat(F.regexp_replace(encoded, "[+/=]", ""), F.substring("h1", 1, 8))
    random = F.when(F.col("id") % 4 == 0, F.substring("h0", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(mixed, 1, 32))).otherwise(F.when(F.col("id") % 4 == 2, encoded).otherwise(mixed))
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.hash("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    four = [part(k) for k in range(4)]
    camel = F.concat(four[0], *[F.initcap(x) for x in four[1:]])
    number = F.concat_ws("_", *four[:3], F.pmod("id", F.lit(100)).cast("string"))
    plain = F.when(F.col("id") % 5 == 0, camel).when(F.col("id") % 5 == 1, F.concat_ws("_", *four)).when(F.col("id") % 5 == 2, F.concat_ws("-", *four)).when(F.col("id") % 5 == 3, F.concat_ws("/", *four)).otherwise(number)
    return ids.select(random.alias("string"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("string"), F.lit(False).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary) for each pair of
    the alphabet, row by row. The row and column after the last stand for any
    other character."""
    chars = F.split("string", "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))
    counts = samples.where("length(string) > 1").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    size = len(ALPHABET) + 1
    place = lambda c: i if (i := ALPHABET.find(c)) >= 0 else size - 1
    # at most two rows for each pair of characters of the samples' alphabet
    known = counts.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()
    table = {True: [[smoothing] * size for _ in range(size)], False: [[smoothing] * size for _ in range(size)]}
    for r in known:
        table[r["random"]][place(r["pair"][0])][place(r["pair"][1])] += r["count"]
    out = []
    for a in range(size):
        for b in range(size):
            p, q = (table[x][a][b] / sum(table[x][a]) for x in (True, False))
            out.append(math.log(p / q))
    return out


def log_ratio(string: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, random over ordinary."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    place = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(size - 1)
    places = F.transform(F.split(string, ""), place)
    steps = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.get(table, a * size + b))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def random_spans(text: Column, model: list[float]) -> Column:
    """Spans of strings that the models call random: of mixed characters only,
    with a digit and a letter. A string is random as a whole, or else a stretch of
    its pieces between the marks = / _ - is, none of which looks ordinary by
    itself (a word, or by its ratio): a name or path beside a random stretch doesn't count against it."""

    def one(m: Column) -> Column:
        ratio = log_ratio(m, model)
        shaped = F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]"))
        return F.when(shaped, (ratio >= TOTAL) & (ratio >= EACH * F.length(m))).otherwise(False)

    span = lambda a, b: F.array(F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))).cast(SPANS)
    closed = lambda s: F.when(s["start"] >= 0, F.concat(s["spans"], span(s["start"], s["end"]))).otherwise(s["spans"])

    def step(s: Column, x: Column) -> Column:
        fits, end = x["fits"], s["at"] + x["n"]
        begins = (s["start"] < 0) & fits & (x["n"] > 0)
        return F.struct(
            (end + 1).alias("at"), F.when(begins, s["at"]).when(fits, s["start"]).otherwise(F.lit(-1)).alias("start"),
            F.when(fits & (x["n"] > 0), end).otherwise(s["end"]).alias("end"), F.when(fits, s["spans"]).otherwise(closed(s)).alias("spans"),
        )

    def stretches(m: Column) -> Column:
        pieces = F.transform(F.split(m, "[=/_-]", -1), lambda x: F.struct(F.length(x).alias("n"), ((x == "") | (F.rlike(x, F.lit("[0-9]|[a-z][A-Z]|[A-Z]{2}")) & (log_ratio(x, model) >= EACH * F.length(x)))).alias("fits")))
        zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(0).alias("end"), _no_spans().alias("spans"))
        return F.filter(F.aggregate(pieces, zero, step, closed), lambda s: F.when(s["end"] - s["start"] >= LEAST, one(F.substring(m, s["start"] + 1, s["end"] - s["start"]))).otherwise(False))

    def found(run: Column) -> Column:
        m = F.substring(text, run["start"] + 1, run["end"] - run["start"])
        moved = F.transform(stretches(m), lambda s: F.struct((s["start"] + run["start"]).alias("start"), s["kind"].alias("kind"), (s["end"] + run["start"]).alias("end")))
        return F.when(one(m), F.array(run)).when(F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[=/_-]")), moved).otherwise(_no_spans())

    # LEAST characters in a row with a digit among them; looks no further
    sign = F.rlike(text, F.lit(r"(?=[A-Za-z0-9+/_=-]{%d})[A-Za-z+/_=-]{0,%d}[0-9]" % (LEAST, LEAST - 1)))
    runs = _matches(text, r"[A-Za-z0-9+/_=-]{%d,}" % LEAST, 3, lambda m: F.rlike(m, F.lit("[0-9]")))
    return F.coalesce(F.when(sign, F.flatten(F.transform(runs, found))), _no_spans())


def find_secrets(df: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, kind, end), kind as a place in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(F.col(id_col), base_spans(text).alias("base"), random_spans(text, model).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select(id_col, "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", apart))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *map(count, range(3)), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
