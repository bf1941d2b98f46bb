"""Personal data by candidate gradient boosting, in DataFrame operations.

Base patterns give spans of four kinds, checked by rule (parts of addresses, digit counts, Luhn); they always count.
Beside them, generators of high recall propose overlapping spans: written-out mail addresses, dotted and colon-separated
numbers, any formatted number of eight digits or more, however long, and runs of twenty letters and digits or more,
which may be secrets (keys, tokens, passwords), a fifth kind without a base pattern. Boosted trees of depth two, fitted
on one half of all proposals, counted by format, to tell those that a rule confirms from the rest, score every proposal by its
format and context without seeing the rule itself (a card number with a typing error looks like a card number; a
telephone number stays one where a rule took it with the digits that follow it; a token stays one where no name stands
before it). The rule of a secret is that it is assigned to a name that says so; of others, that the base pattern takes
them, read on their own. Thresholds for each kind are calibrated on the other half: the lowest score
from which ``PRECISION`` of proposals are confirmed; a kind that never gets there adds none by score. Spans at or above
the threshold, and secrets that their names confirm, are added.

Trees are applied as expressions within the row, so documents are neither shuffled nor joined. Null text is empty. Rows
with equal ids are separate rows. Quantifiers are possessive and anchored, or give back what they took once only, so that
no text, however long or repetitive, makes a match take more than a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
TREES, RATE, PRECISION, BLOCK = 10, 0.4, 0.9, 256

#: Leftmost, non-overlapping; the look-behind states what leftmost implies, and so spares the retries within a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])[0-9]{1,4}+(?:[.:][0-9]{1,4}+){3,7}+",
    "number": r"(?<![A-Za-z0-9])\+?[0-9(](?:[ ().-]{0,2}[0-9]){7,}+",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
CONTEXT = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|pay|iban|account|ip|host|server|addr)[^\n]{0,16}$"
ASSIGNED = r"(?i)(?:token|secret|api.?key|access.?key|private.?key|passw(?:or)?d|pwd|credential|authorization|bearer)[\"']?\s{0,2}(?:=>?|:)?\s{0,2}[\"']?$"
FEATURES = ("kind", "length", "digits", "separators", "dots", "lead", "named", "left", "right", "upper", "hex")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before, after) of the matches of a pattern; places count code points.

    Before and after are what stands beside a match up to the next match: at most 32 code points, and one. They come from
    the gaps, and places are summed within blocks of ``BLOCK`` matches and then over blocks, so that a text of very many
    matches is not read once a match.
    """
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def beside(m: Column, gaps: Column) -> Column:
        led = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda x, g: F.struct(x.alias("m"), g.alias("g")))
        return F.zip_with(
            led,
            F.slice(gaps, F.lit(2), F.size(m)),
            lambda x, g: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(32)).alias("before"), F.substring(g, 1, 1).alias("after")),
        )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        placed = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(placed)).alias("out"))

    def moved(at: Column, x: Column) -> Column:
        return F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

    def place(rows: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))
        blocks = F.transform(first, lambda k: F.aggregate(F.slice(rows, k, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        offsets = F.array().cast("array<int>")
        return _let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    F.aggregate(bs, F.struct(F.lit(0).alias("at"), offsets.alias("out")), lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"],
                    lambda b, at: F.transform(b["out"], lambda x: moved(at, x)),
                )
            ),
        )

    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(_let(gaps, lambda g: beside(m, g)), place)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(d, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    return n.between(10, 15)


def _spans(text: Column) -> Column:
    """Base spans as (start, kind, end); kind is the place in ``KINDS``."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(_located(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _proposals(text: Column) -> Column:
    """Proposed spans (start, kind, end, m) with their features ``x``; ``sure``: a secret that its name confirms."""

    def of(name: str, pattern: str) -> Column:
        def counted(x: Column) -> Column:
            n = F.length(_digits(x["m"]))
            return F.struct(n.alias("n"), F.ascii(F.right(x["before"], F.lit(1))).alias("left"), x.alias("at"))

        def row(c: Column) -> Column:
            x, n = c["at"], c["n"]
            m = x["m"]
            kind = {"email": F.lit(0), "ip": F.lit(1), "secret": F.lit(SECRET)}.get(name, F.when(n >= 13, 2).otherwise(3))
            sure = x["before"].rlike(ASSIGNED) if name == "secret" else F.lit(False)
            named = F.lit(False) if name == "secret" else x["before"].rlike(CONTEXT)  # not the rule of the label
            upper = F.length(m) - F.length(F.regexp_replace(m, "[A-Z]", ""))
            separators = F.length(m) - F.length(F.regexp_replace(m, "[ ()-]", ""))
            dots = F.length(m) - F.length(F.replace(m, F.lit("."), F.lit("")))
            values = (kind, F.length(m), n, separators, dots, F.ascii(m), named, c["left"], F.ascii(x["after"]), upper, m.rlike("^[0-9A-Fa-f]+$"))
            features = F.array(*[F.least(v.cast("int"), F.lit(127)) for v in values])
            return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), m.alias("m"), features.alias("x"), sure.alias("sure"))

        return F.transform(F.transform(_located(text, pattern), counted), row)

    return F.concat(*(of(name, pattern) for name, pattern in PROPOSE.items()))


def _confirmed(kind: Column, m: Column) -> Column:
    """Whether the base rule of the kind takes the proposal, read on its own, as a whole."""
    out = F.lit(False)
    for k, name in enumerate(KINDS):
        out = out | ((kind == k) & m.rlike(f"^(?:{BASE[name]})$") & ~m.endswith("\n") & _valid(name, m))
    return out


def _tree(x: Column, tree: tuple) -> Column:
    """A tree is a leaf value or (feature, limit, tree at or below, tree above)."""
    if isinstance(tree, float):
        return F.lit(tree)
    f, limit, low, high = tree
    return F.when(x[f] <= limit, _tree(x, low)).otherwise(_tree(x, high))


def _margin(x: Column, trees: list) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + _tree(x, t)
    return total


def _path(x: Column, tests: list) -> Column:
    out = F.lit(True)
    for f, limit, low in tests:
        out = out & ((x[f] <= limit) if low else (x[f] > limit))
    return out


def _best_split(rows: DataFrame, trees: list, nodes: list[list]) -> list[tuple | float]:
    """For each node (a list of tests) its best split, or its leaf value: one aggregation into feature-value sums."""
    p = 1 / (1 + F.exp(-_margin(F.col("x"), trees)))
    node = F.lit(-1)
    for k, tests in enumerate(nodes):
        node = F.when(_path(F.col("x"), tests), k).otherwise(node)
    flat = rows.select(node.alias("node"), (F.col("n") * (F.col("y") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), F.posexplode("x").alias("f", "v")).where("node >= 0")
    sums: dict = {}
    for r in flat.groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).orderBy("node", "f", "v").collect():  # at most nodes x features x 128
        sums.setdefault((r["node"], r["f"]), []).append((r["v"], r["g"], r["h"]))
    out: list[tuple | float] = []
    for k in range(len(nodes)):
        own = {f: v for (n, f), v in sums.items() if n == k}
        if not own:
            out.append(0.0)
            continue
        g, h = (sum(x[j] for x in next(iter(own.values()))) for j in (1, 2))
        best = (1e-3, None)
        for f, values in own.items():
            gl = hl = 0.0
            for v, dg, dh in values[:-1]:
                gl, hl = gl + dg, hl + dh
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = gain, (f, v, RATE * gl / (hl + 1), RATE * (g - gl) / (h - hl + 1))
        out.append(best[1] or RATE * g / (h + 1))
    return out


def _boost(rows: DataFrame) -> list:
    trees: list = []
    for _ in range(TREES):
        root = _best_split(rows, trees, [[]])[0]
        if isinstance(root, float):
            trees.append(root)
            break
        f, limit, low, high = root
        left, right = _best_split(rows, trees, [[(f, limit, True)], [(f, limit, False)]])
        trees.append((f, limit, left, right))
    return trees


def _thresholds(rows: DataFrame, trees: list) -> list[float]:
    """For each kind the lowest margin from which enough proposals are confirmed, in steps of 0.1.

    It lies halfway to the next step with proposals; where there is none, every proposal of the kind is added.
    """
    bins: dict[int, list] = {k: [] for k in range(len(ALL_KINDS))}
    step = F.floor(_margin(F.col("x"), trees) * 10).cast("int")
    for r in rows.groupBy(F.col("x")[0].alias("kind"), step.alias("bin")).agg(F.sum(F.col("y") * F.col("n")).alias("y"), F.sum("n").alias("n")).collect():  # kinds x score steps
        bins[r["kind"]].append((r["bin"], r["y"], r["n"]))
    out = []
    for k in range(len(ALL_KINDS)):
        limit, yes, n, rows = float("inf"), 0, 0, sorted(bins[k], reverse=True)
        for (b, y, m), below in zip(rows, [*rows[1:], None], strict=False):
            yes, n = yes + y, n + m
            if n >= 20 and yes >= PRECISION * n:
                limit = (b + below[0] + 1) / 20 if below else float("-inf")
        out.append(limit)
    return out


def _formats(found: DataFrame) -> DataFrame:
    """x, y, fit, n: how often proposals of each format occur, confirmed (y) or not, in either half of all proposals."""
    each = found.select("doc_id", F.explode_outer("proposed").alias("p")).where("p is not null")
    sure = (F.col("p.sure") | _confirmed(F.col("p.kind"), F.col("p.m"))).cast("int")
    fit = F.xxhash64("doc_id", "p.start", "p.m") % 2 == 0
    return each.groupBy(F.col("p.x").alias("x"), sure.alias("y"), fit.alias("fit")).agg(F.count("*").alias("n"))


def find_personal_data(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, base and all: arrays of (start, kind, end) in code points, by start and kind, for every row of ``docs``.

    ``with_text`` keeps the text beside them.
    """
    scratch = Scratch(docs.sparkSession)
    keep = ["doc_id", "text"] if with_text else ["doc_id"]
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.select(*keep, _spans(F.col("text")).alias("base"), _proposals(F.col("text")).alias("proposed"))
    found = scratch.save(found, "found")
    rows = scratch.save(_formats(found), "formats")
    trees = _boost(rows.where("fit"))
    limits = _thresholds(rows.where("not fit"), trees)

    def wanted(p: Column) -> Column:
        score = _margin(p["x"], trees)
        out = p["sure"]
        for k, limit in enumerate(limits):
            if limit != float("inf"):
                out = out | ((p["kind"] == k) & (score >= limit))
        return out

    added = F.transform(F.filter("proposed", wanted), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return found.select(*keep, "base", F.array_sort(F.array_distinct(F.concat("base", added))).alias("all"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, redacted: each text with its spans replaced by the kind in brackets; of overlapping spans the first holds."""
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        name = F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["kind"] + 1)
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), name, F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    done = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rows = find_personal_data(docs, with_text=True).withColumn("_r", done)
    return rows.select("doc_id", F.concat(F.col("_r.out"), F.substr(text, F.col("_r.at") + 1, F.length(text))).alias("redacted"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
