"""Personal data by candidate gradient boosting, in DataFrame expressions.

Strict patterns give the base spans, which always stay. Looser generators
propose more spans, which may overlap them: a card or phone number inside a
longer run of digits that fails as a whole, a phone number without a country
code, an address with spelt-out or spaced signs. What such a span is cannot be
told from its form alone (5 @ 3.50, an order number, "meet me @ noon . thanks"),
so boosted trees judge it by format and context features: digits, checksum,
separators and signs, the shape of an address's ends, neighbouring characters,
words before it that tell of its kind or of something else.

The trees are fitted on a bounded set of labelled texts that are generated
from a seed (EXAMPLES of them): disguised addresses and numbers in telling and
in plain surroundings, and the things that look like them. A third of the
texts is held out; each kind's threshold is the least score at which the
candidates of the held-out texts reach PRECISION. The corpus is read once, by
expressions alone.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass, field
from functools import cache, partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Kinds in the order of reports: fixed values.
KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Possessive loops and looks behind keep them linear and change no match.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9])(?=[+(0-9])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Words before a span that tell of each kind, or of something else: fixed values.
TELLING = {"email": r"(?i)mail|address|contact|write|reach", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|credit|charge|pay", "phone": r"(?i)phone|tel\b|tel\.|call|fax|mobile|ring|dial"}
DENYING = r"(?i)order|isbn|version|invoice|ticket|part|item|model|serial|\bid\b|\bref|\bno\b|score|ratio|from|page|total|each|price"
FEATURES = ("kind", "digits", "luhn", "octets", "plus", "paren", "seps", "prev", "next", "telling", "denying", "spelt", "spaced", "head", "tail")
ROUNDS, DEPTH, RATE, PRECISION = 30, 4, 0.4, 0.98
#: Labelled texts that the trees are fitted on, and the remainder of their number modulo 3 that is held out.
EXAMPLES, HELD_OUT, SEED = 3000, 2, 11
#: Matches whose places are added up together.
RUN = 256

SPAN = "array<struct<s:int,e:int,t:string>>"


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their places in code points, end exclusive."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"))

    def walk(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["between"], i))
            end = start + F.length(F.get(x["m"], i))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), F.get(x["m"], i).alias("t")))).alias("out"))

        # runs of matches, so that no long array is copied for each match
        def run(acc: Column, first: Column) -> Column:
            one = F.aggregate(F.sequence(first, F.least(first + (RUN - 1), F.size(x["m"]) - 1)), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
            return let(one, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.when(F.size(x["m"]) == 0, F.array().cast(SPAN)).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1, F.lit(RUN)), start, run, lambda acc: acc["out"])))

    return let(found, walk)


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.when(F.length(digits) == 0, F.lit(False)).otherwise(F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0)


def octets(t: Column) -> Column:
    """Whether every number of a dotted text is at most 255."""
    return F.forall(F.split(t, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) <= 3) & (F.coalesce(z.try_cast("int"), F.lit(0)) <= 255)))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def passes(kind: str, t: Column) -> Column:
    """The test of a strict match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(t)
    n = F.length(_digits(t))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(_digits(t))).otherwise(False)
    return (n >= 9) & (n <= 15)


def _neighbour(c: Column) -> Column:
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 1).otherwise(3)


def _candidate(text: Column, kind: str, x: Column, strict: bool) -> Column:
    t = x["t"]
    signs = F.regexp_replace(t, r"[0-9A-Za-z+()]", "")
    n = F.length(_digits(t))
    small = F.when((n >= 13) & (n <= 19), luhn(_digits(t))).otherwise(False)
    before = F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    whether = lambda c: c.cast("int")
    if kind == "email":
        # an address is known by letters before its sign, and by a short word of letters at its end
        head, tail = F.when(t.rlike("^[0-9._%+-]+[^A-Za-z]"), 0).otherwise(1), F.when(t.rlike(r"[0-9]$|[-]$"), 0).when(t.rlike("[^A-Za-z](?:com|org|net|edu|gov|info|io|de|fr|es|uk|cn)$"), 2).otherwise(1)
        spelt, spaced = whether(t.rlike(r"[\[(]")), whether(t.contains(" "))
    else:
        head = tail = spelt = spaced = F.lit(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(strict).alias("strict"),
        (passes(kind, t) if strict else F.lit(False)).alias("base"),
        F.least(n, F.lit(20)).alias("digits"), whether(small).alias("luhn"), whether(octets(t) if kind == "ip" else F.lit(False)).alias("octets"),
        whether(t.startswith("+")).alias("plus"), whether(t.contains("(")).alias("paren"),
        F.when(signs == "", 0).when(F.length(F.regexp_replace(signs, r"^(.)\1*$", "")) == 0, 1).otherwise(2).alias("seps"),
        _neighbour(F.substring(text, x["s"], F.when(x["s"] > 0, 1).otherwise(0))).alias("prev"), _neighbour(F.substring(text, x["e"] + 1, F.lit(1))).alias("next"),
        whether(before.rlike(TELLING[kind])).alias("telling"), whether(before.rlike(DENYING)).alias("denying"),
        spelt.alias("spelt"), spaced.alias("spaced"), head.alias("head"), tail.alias("tail"),
    )


def _all_of(kind: str, pattern: str, strict: bool, text: Column) -> Column:
    return F.transform(find(text, pattern), lambda x: _candidate(text, kind, x, strict))


def candidates(text: Column) -> Column:
    """All candidates of a text, strict ones first."""
    text = F.coalesce(text, F.lit(""))
    needs = {"email": text.rlike(r"@|\(at\)|\[at\]"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}|\+[0-9]")}
    parts = []
    for strict, patterns in ((True, STRICT), (False, LOOSE)):
        for kind in KINDS:
            parts.append(F.when(needs[kind], let(text, partial(_all_of, kind, patterns[kind], strict))))
    empty = F.filter(F.transform(F.array().cast(SPAN), lambda x: _candidate(text, "email", x, True)), lambda x: F.lit(False))
    return F.flatten(F.array(*(F.coalesce(p, empty) for p in parts)))


@dataclass
class Model:
    """Boosted trees over the features of candidates, and a threshold for each kind."""

    bias: float
    trees: list
    thresholds: dict[int, float]
    #: precision and recall of each kind on the held-out texts
    figures: dict[str, tuple[float, float]] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            column, at, low, high = node
            return np.where(rows[:, column] <= at, walk(low, rows), walk(high, rows))

        return self.bias + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def score(self, c: Column) -> Column:
        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            column, at, low, high = node
            return F.when(c[FEATURES[column]] <= F.lit(at), walk(low)).otherwise(walk(high))

        return reduce(lambda a, b: a + b, (walk(t) for t in self.trees), F.lit(float(self.bias)))

    def accepts(self, c: Column) -> Column:
        return reduce(lambda rest, k: F.when(c["kind"] == k, self.score(c) >= F.lit(float(self.thresholds[k]))).otherwise(rest), self.thresholds, F.lit(False))


def _tree(x, residual, weight, n, depth):
    """A regression tree by Newton gain; n: how many candidates each pattern stands for."""
    total, mass = (residual * n).sum(), (weight * n).sum()
    leaf = RATE * total / (mass + 1.0)
    if depth == 0:
        return float(leaf)
    best = (1e-6, None)
    for column in range(x.shape[1]):
        for at in np.unique(x[:, column])[:-1].tolist():
            left = x[:, column] <= at
            g, h = (residual * n)[left].sum(), (weight * n)[left].sum()
            gain = g * g / (h + 1.0) + (total - g) ** 2 / (mass - h + 1.0) - total**2 / (mass + 1.0)
            if gain > best[0] + 1e-9:
                best = (gain, (column, at))
    if best[1] is None:
        return float(leaf)
    column, at = best[1]
    left = x[:, column] <= at
    return (column, at, *(_tree(x[s], residual[s], weight[s], n[s], depth - 1) for s in (left, ~left)))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int, int, bool]]:
    """Labelled texts (text, kind, start, end, whether the span is personal), the same for the same seed."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(0, 5)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    end = lambda: rng.choice(["com", "org", "net", "edu", "de", "fr", "es", "io", "info"])

    def number(good):
        body = digits(15)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, body[::-1])))
        last = -total % 10 if good else (-total + rng.randrange(1, 10)) % 10
        raw, gap = body + str(last), rng.choice(["", " ", "-"])
        return gap.join(raw[i : i + 4] for i in range(0, 16, 4))

    def address():
        user, at, dot = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}"]), *rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), ("@", " . "), (" @ ", " . ")])
        return f"{user}{at}{word()}{dot}{end()}"

    def local():
        return rng.choice([f"{digits(3)} {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(2)} {digits(3)} {digits(4)}"])

    def abroad():
        return f"+{digits(1) if rng.random() < 0.5 else digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}"

    tells = {"email": ["mail me at", "my address:", "contact", "write to", "reach me via"], "phone": ["call", "tel.", "my phone is", "fax", "mobile", "ring me on"], "card": ["card", "visa", "my credit card", "charge it to", "pay with"], "ip": ["host", "server", "ip", "from addr"]}
    denies = ["order", "isbn", "version", "invoice", "ticket", "part no", "item", "model", "serial", "ref", "score", "from page", "total"]
    # (kind, words before, span, words after, personal)
    makers = [
        lambda: ("email", rng.choice(tells["email"]), address(), prose(), True),
        lambda: ("email", prose(), address(), prose(), True),
        lambda: ("email", rng.choice(["items", "ratio", "lot of", "sold", prose()]), f"{rng.randrange(1, 99)} @ {rng.randrange(1, 99)}.{digits(rng.randrange(1, 3))}", rng.choice(["each", "per unit", prose()]), False),
        lambda: ("email", rng.choice(["meet me", "see you", prose()]), f"{word()} @ {rng.choice(['noon', 'home', 'work', 'lunch', word()])} . {word()}", prose(), False),
        lambda: ("email", prose(), f"{word()} @ {word()}.{word()}{word()}", prose(), False),
        lambda: ("phone", rng.choice(tells["phone"]), local(), prose(), True),
        lambda: ("phone", rng.choice([prose(), *tells["phone"]]), abroad(), prose(), True),
        lambda: ("phone", rng.choice(denies), local(), prose(), False),
        lambda: ("phone", prose(), local(), prose(), rng.random() < 0.2),
        lambda: ("card", rng.choice([prose(), *tells["card"]]), number(True), prose(), True),
        lambda: ("card", rng.choice(denies), number(rng.random() < 0.1), prose(), False),
        lambda: ("card", prose(), number(False), prose(), False),
        lambda: ("ip", rng.choice(tells["ip"]), ".".join(str(rng.randrange(256)) for _ in range(4)), prose(), True),
        lambda: ("ip", rng.choice(["version", "section", "build"]), ".".join(str(rng.randrange(400)) for _ in range(4)), prose(), False),
    ]
    out = []
    for i in range(n):
        kind, before, span, after, personal = makers[i % len(makers)]()
        head = f"{prose()} {before}".strip()
        head = f"{head} " if head else ""
        out.append((f"{head}{span} {after}".rstrip(), kind, len(head), len(head) + len(span), personal))
    return out


@cache
def fit(spark: SparkSession) -> Model:
    """Fit on the generated texts; one row per feature pattern reaches the driver. The model is the same in every session."""
    rows = [(i, *row) for i, row in enumerate(examples())]
    texts = spark.createDataFrame(rows, "i int, text string, k string, a int, b int, personal boolean")
    names = F.array(*map(F.lit, KINDS))
    one = texts.select("i", "k", "a", "b", "personal", F.explode(candidates(F.col("text"))).alias("c")).where("not c.strict")
    # a candidate counts as its text says if it is most of the span
    right = F.col("personal") & (F.get(names, F.col("c.kind")) == F.col("k")) & (2 * (F.least("c.e", "b") - F.greatest("c.s", "a")) > F.greatest(F.col("b") - F.col("a"), F.col("c.e") - F.col("c.s")))
    found = one.groupBy((F.col("i") % 3 == HELD_OUT).alias("held"), *(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("good")).orderBy("held", *FEATURES).collect()
    held = np.array([r["held"] for r in found], bool)
    x = np.array([[r[f] for f in FEATURES] for r in found], float).reshape(len(found), len(FEATURES))
    n, good = np.array([r["n"] for r in found], float), np.array([r["good"] for r in found], float)
    tx, tn, tg = x[~held], n[~held], good[~held]
    share = (tg.sum() + 1) / (tn.sum() + 2)
    model = Model(float(np.log(share / (1 - share))), [], {})
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-model.raw(tx)))
        model.trees.append(_tree(tx, tg / tn - p, p * (1 - p), tn, DEPTH))
    raw = model.raw(x)
    for kind in range(len(KINDS)):
        mine = held & (x[:, 0] == kind)
        # the least score from which on held-out candidates are right often enough
        for at in sorted(set(raw[mine].tolist())):
            above = mine & (raw >= at)
            if good[above].sum() >= PRECISION * n[above].sum():
                model.thresholds[kind] = at - 1e-9
                break
        chosen = mine & (raw >= model.thresholds.get(kind, np.inf))
        model.figures[KINDS[kind]] = good[chosen].sum() / max(1.0, n[chosen].sum()), good[chosen].sum() / max(1.0, good[mine].sum())
    return model


def _code(c: Column) -> Column:
    """A span as one number, in the order of reports."""
    return F.shiftleft(c["kind"].cast("long"), 58) + F.shiftleft(c["s"].cast("long"), 29) + c["e"].cast("long")


def spans(found: Column, model: Model) -> Column:
    """Base spans and accepted looser ones, by kind and start. A looser span adds nothing where it touches a base span of its kind, or is itself a strict candidate, which its test has judged."""
    part = lambda v, shift, bits: F.shiftright(v, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def joined(x: Column) -> Column:
        base, more = x["base"], F.array_except(x["more"], x["strict"])
        kind, s, e = (lambda v: part(v, 58, 3)), (lambda v: part(v, 29, 29)), (lambda v: part(v, 0, 29))
        free = F.filter(more, lambda c: ~F.exists(base, lambda y: (kind(y) == kind(c)) & (s(y) < e(c)) & (s(c) < e(y))))
        return F.transform(F.array_sort(F.concat(base, free)), lambda v: F.struct(kind(v).alias("kind"), s(v).alias("s"), e(v).alias("e")))

    codes = lambda keep: F.transform(F.filter(found, keep), _code)
    return let(F.struct(codes(lambda c: c["base"]).alias("base"), codes(lambda c: c["strict"]).alias("strict"), codes(lambda c: ~c["strict"] & model.accepts(c)).alias("more")), joined)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["s"], c["e"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256, and spans (base and added).

    A null text is empty and has no spans. Null and repeated keys are read like
    any other, and repeated rows each on their own. The model depends on no
    row, so neither does a text's result on other texts. An empty table gives
    an empty table. Other columns are not read.
    """
    model = fit(docs.sparkSession)
    # a generator's output: the candidates are found once for all columns
    found = docs.select("doc_id", F.explode(F.array(candidates(F.col("text")))).alias("found"))
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
    count = lambda k: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == k))).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans(F.col("found"), model)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first. n_chars, where there is one, is counted anew for texts that change.

    A null text stays null, and an empty one empty; null keys, repeated rows
    and other columns pass unchanged. An
    empty table gives an empty table.
    """
    model = fit(docs.sparkSession)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(x: Column) -> Column:
        ordered = F.array_sort(F.transform(x["spans"], lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(x["text"], acc["at"] + 1, c["s"] - acc["at"]), F.get(names, c["kind"]))
            return F.when(c["s"] < acc["at"], F.struct(F.greatest(acc["at"], c["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(c["e"].alias("at"), piece.alias("out")))

        return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(x["text"], acc["at"] + 1, F.length(x["text"]))))

    own = next(f"_found{k}" for k in itertools.count() if f"_found{k}" not in docs.columns)
    parts = docs.withColumn(own, F.explode(F.array(let(candidates(F.col("text")), lambda f: spans(f, model)))))
    text = F.when(F.size(own) == 0, F.col("text")).otherwise(let(F.struct(F.col("text").alias("text"), F.col(own).alias("spans")), replaced))
    out = parts.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(own) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op6_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
