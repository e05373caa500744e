"""Personal data: overlapping candidates, boosted trees, calibrated redactions.

High-recall generators propose spans: the base pattern of each kind, and loose
ones beside it, which also fit words and numbers that are no personal data. Two
views of a span are kept apart. Its content, written in the kind's plain form, is
checked (a host with a top-level name, octets, length and Luhn, a number of the
length and area code of a telephone): passing or failing labels it. Its format
and context (runs, separators, neighbours, key words before it) are its features,
of which none is that check's outcome. Gradient-boosted trees learn from half of
the documents how often spans of a format and context pass; the other half gives
each kind the lowest score that keeps the wanted precision. A proposal beyond the
base is redacted where its content passes and the trees, compiled to a column
expression, score spans like it above that. So a number that happens to pass, in
a format whose numbers mostly fail, stays; base spans are always redacted.

All of it is DataFrame functions. Spans are counted by feature vector, and the
driver sees these counts alone: VECTORS of a kind at most, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, with possessive repeats and look-behinds
# that change no match and keep the time linear in the text.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:[ ]?[\[({<][ ]?(?:at|AT|At|@)[ ]?[\])}>][ ]?|[ ]@[ ]?|@[ ])"
_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|DOT|Dot|\.)[ ]?[\])}>][ ]?|[ ](?:dot|DOT|\.)[ ]|\.)"
_SPOKEN_AT, _SPOKEN_DOT = r"[ ](?:at|AT)[ ]", r"[ ](?:dot|DOT)[ ]"
_HOST = "[A-Za-z0-9-]++"
_IP_SEP = r"(?:[ ]?[\[({<][ ]?(?:\.|dot)[ ]?[\])}>][ ]?|[ ]dot[ ]|[ ]\.[ ])"
_CARD_SEP = r"(?:[._/,: ‐-―]|[ ][./‐-―-][ ]|[ ]{2}|[-]{2})"
#: Loose proposals of each kind: written around, spaced out, or with other separators.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_HOST}(?:{_DOT}{_HOST})*+|{_SPOKEN_AT}{_HOST}(?:{_SPOKEN_DOT}{_HOST})*+)",
    "ip": rf"(?<![0-9.])[0-9]{{1,4}}+({_IP_SEP})[0-9]{{1,4}}+\1[0-9]{{1,4}}+\1[0-9]{{1,4}}+(?![0-9])",
    "card": rf"(?<![0-9])[0-9]{{2,6}}+({_CARD_SEP})[0-9]{{2,7}}+(?:\1[0-9]{{1,7}}+){{1,5}}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.,:/_-])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}+[ ./-]{1,2}+)[0-9]{2,5}+(?:[ ./-]{1,2}+[0-9]{2,5}+){0,4}+(?![0-9A-Za-z])",
}
#: A cheap test that every text with a proposal passes.
_QUICK = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.rlike(r"@|\b(?:at|AT|At)\b"),
    ("ip", False): lambda t: t.rlike(rf"[0-9]{_IP_SEP}[0-9]"),
    ("card", False): lambda t: t.rlike(rf"[0-9]{_CARD_SEP}[0-9]"),
    ("phone", False): lambda t: t.rlike(r"[0-9]\)?[ ./-]{1,2}[0-9]"),
}
#: Key words of each kind, of which the last 24 characters before a span may hold one.
KEYS = {
    "email": r"mail|contact|write|reach|correo|adresse|courriel",
    "ip": r"\bip\b|host|server|address|node|gateway|login",
    "card": r"card|visa|master|amex|pay|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|cell|ruf|appel|llam",
}
_NEAR = 24
#: The features of a vector, and how many values each has.
FEATURES = {"before": 3, "after": 3, "key": 3, "separator": 7, "mixed": 2, "runs": 6, "first": 6, "last": 6, "letters": 3}
#: Vectors of a kind, at most.
VECTORS = 3 * 3 * 3 * 7 * 2 * 6 * 6 * 6 * 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.length(digits)
    # code points of the digits, the last first; every second one is doubled
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.ascii(F.substring(digits, n - k, F.lit(1))) - 48)
    total = F.aggregate(F.transform(d, lambda x, k: F.when(k % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return F.when(n > 0, total % 10 == 0).otherwise(False)


_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"


def _valid(kind: str, m: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _plain(kind: str, m: Column) -> Column:
    """Whether a loose proposal's content, in the kind's plain form, is one of the kind."""
    d = _digits(m)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, rf"^({_LOCAL}++)(?:{_AT}|{_SPOKEN_AT})", "$1@"), rf"(?<=[A-Za-z0-9-]){_DOT}(?=[A-Za-z0-9-])", ".")
        return plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    if kind == "ip":
        return F.regexp_replace(m, "[^0-9]+", ".").rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    if kind == "card":
        return _valid(kind, m)
    return d.rlike("^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|00[1-9][0-9]{8,12}|0[1-9][0-9]{7,9})$")


def _class(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 1).otherwise(0)


def _vector(kind: str, m: Column, before: Column, after: Column) -> Column:
    """The features of a match between the text before and after it, as one number.

    before and after end at the neighbouring matches of the same generator.
    """
    runs = F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), F.lit(0))
    seps = F.regexp_replace(m, "[A-Za-z0-9]+", "")
    near = F.lower(F.right(before, F.lit(_NEAR)))
    others = "|".join(v for k, v in KEYS.items() if k != kind)
    one = F.left(seps, F.lit(1))
    bins = [
        _class(F.right(before, F.lit(1))),
        _class(F.left(after, F.lit(1))),
        F.when(near.rlike(KEYS[kind]), 2).when(near.rlike(others), 1).otherwise(0),
        F.when(one == "", 0).when(seps.rlike(r"[\[({<]"), 4).when(one == " ", 1).when(one == "-", 2).when(one == ".", 3).when(one.isin("@", "+"), 5).otherwise(6),
        (F.length(F.replace(seps, one, F.lit(""))) > 0).cast("int"),
        F.least(F.size(runs), F.lit(5)),
        F.least(F.length(F.try_element_at(runs, F.lit(1))), F.lit(5)),
        F.least(F.length(F.try_element_at(runs, F.lit(-1))), F.lit(5)),
        F.when(~m.rlike("[A-Za-z]"), 0).when(~m.rlike("[0-9]"), 1).otherwise(2),
    ]
    out = F.lit(0).cast("long")
    for b, size in zip(bins, FEATURES.values()):
        out = out * size + F.coalesce(b, F.lit(0)).cast("long")
    return out


_FEW = 256


def _blocks(values: Column) -> Column:
    """The array in pieces of _FEW elements."""
    return _with(values, lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / _FEW).cast("int")), lambda k: F.slice(vs, k * _FEW + 1, F.lit(_FEW))))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima) of an array of integers that is not empty.

    A fold that grows an array copies it for each element, so only pieces of _FEW
    elements are folded so, and then their totals: a million matches are 4,000 pieces.
    """
    scan = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, join(F.element_at(out, -1), x)).otherwise(x))))
    joined = lambda pieces: _with(scan(F.transform(pieces, lambda x: F.element_at(x, -1))), lambda upto: F.flatten(F.transform(pieces, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda v: join(F.get(upto, k - 1), v))))))
    return _with(F.transform(_blocks(values), scan), joined)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(df: DataFrame, kind: str, base: bool) -> DataFrame:
    """df with one more column: the proposals (start, kind, end, status, vector) of one pattern.

    status: 2 for a base span and 0 for a base match that fails its check, 3 and 1
    for loose proposals whose content passes and fails. Starts and ends are in code
    points. The matches and the pieces between them lie in turn, so their lengths'
    running sum is the position.
    """
    pattern, k = (BASE if base else LOOSE)[kind], KINDS.index(kind)
    hit = _QUICK[kind, base](F.col("text"))
    none = F.array().cast("array<string>")
    df = df.withColumn("m", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("p", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(none))
    step = F.arrays_zip(F.transform("m", lambda x: F.length(x)).alias("n"), F.transform(F.slice("p", 1, F.size("m")), lambda x: F.length(x)).alias("g"))
    ends = _running(F.transform(step, lambda v: v.n + v.g), lambda a, x: a + x)
    df = df.withColumn("e", F.when(F.size("m") > 0, ends).otherwise(F.array().cast("array<int>")))
    after = F.slice("p", 2, F.size("m"))
    zipped = F.arrays_zip(F.col("m"), F.slice("p", 1, F.size("m")).alias("g"), after.alias("h"), F.col("e"))

    def one(v: Column) -> Column:
        status = F.when(_valid(kind, v.m), 2).otherwise(0) if base else F.when(_plain(kind, v.m), 3).otherwise(1)
        return F.struct((v.e - F.length(v.m)).alias("s"), F.lit(k).alias("k"), v.e.alias("e"), status.alias("t"), _vector(kind, v.m, v.g, v.h).alias("v"))

    return df.withColumn(f"x{k}{int(base)}", F.when(F.size("m") > 0, F.transform(zipped, one)).otherwise(F.array().cast(_PROPOSALS))).drop("m", "p", "e")


_PROPOSALS = "array<struct<s:int,k:int,e:int,t:int,v:bigint>>"


class Trees:
    """Gradient-boosted trees of depth two over binned vectors, by logistic loss.

    Fitted in closed form to counted vectors: the same as a fit to every span.
    """

    def __init__(self, rounds: int = 24, rate: float = 0.4):
        self.rounds, self.rate = rounds, rate
        self.prior, self.trees = 0.0, []

    @staticmethod
    def bins(vector: int) -> tuple[int, ...]:
        out = []
        for size in reversed(FEATURES.values()):
            vector, b = divmod(vector, size)
            out.append(b)
        return tuple(reversed(out))

    def fit(self, counted: dict[int, tuple[int, int]]) -> "Trees":
        """counted: vector -> (spans, positive spans)."""
        rows = [(self.bins(v), n, p) for v, (n, p) in sorted(counted.items())]
        total, positive = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.prior = math.log((positive + 1) / (total - positive + 1))
        score = [self.prior] * len(rows)
        for _ in range(self.rounds):
            prob = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
            grad = [r[2] - r[1] * p for r, p in zip(rows, prob)]
            hess = [r[1] * p * (1 - p) for r, p in zip(rows, prob)]
            tree = self._split(rows, grad, hess, list(range(len(rows))), 2)
            self.trees.append(tree)
            score = [s + self._of(tree, r[0]) for s, r in zip(score, rows)]
        return self

    def _split(self, rows, grad, hess, inside, depth):
        g, h = sum(grad[k] for k in inside), sum(hess[k] for k in inside)
        leaf = self.rate * g / (h + 1.0)
        best = (1e-6, None, None)
        for f in range(len(FEATURES)) if depth else ():
            by: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for k in inside:
                cell = by[rows[k][0][f]]
                cell[0] += grad[k]
                cell[1] += hess[k]
            gl = hl = 0.0
            for cut in sorted(by)[:-1]:
                gl += by[cut][0]
                hl += by[cut][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None:
            return leaf
        _, f, cut = best
        low = [k for k in inside if rows[k][0][f] <= cut]
        high = [k for k in inside if rows[k][0][f] > cut]
        return (f, cut, self._split(rows, grad, hess, low, depth - 1), self._split(rows, grad, hess, high, depth - 1))

    def _of(self, tree, bins) -> float:
        while isinstance(tree, tuple):
            f, cut, low, high = tree
            tree = low if bins[f] <= cut else high
        return tree

    def score(self, vector: int) -> float:
        bins = self.bins(vector)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + sum(self._of(t, bins) for t in self.trees)))))

    def column(self, vector: Column) -> Column:
        """The trees' margin as an expression."""
        sizes = list(FEATURES.values())
        cell = [F.pmod(F.floor(vector / F.lit(math.prod(sizes[k + 1 :]))), F.lit(sizes[k])) for k in range(len(sizes))]

        def one(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, cut, low, high = tree
            return F.when(cell[f] <= cut, one(low)).otherwise(one(high))

        out = F.lit(self.prior)
        for t in self.trees:
            out = out + one(t)
        return out


def calibrate(trees: Trees, counted: dict[int, tuple[int, int]], precision: float) -> float:
    """The lowest score, of a half or more, from which on the counted loose spans keep the precision.

    1 where there are some and no score keeps it. Where there are none, a half: the
    trees' judgement of base spans and failed matches decides then.
    """
    by: dict[float, list[int]] = defaultdict(lambda: [0, 0])
    for v, (n, p) in counted.items():
        cell = by[round(trees.score(v), 9)]
        cell[0] += n
        cell[1] += p
    best, n, p = 0.5 if not by else 1.0, 0, 0
    for s in sorted(by, reverse=True):
        n, p = n + by[s][0], p + by[s][1]
        if p >= precision * n:
            best = s
    return max(best, 0.5)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """Per row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the base spans; spans holds these and the
    added ones, as kind:start:end in code points, end exclusive, by start, then
    kind. An added span overlaps no base span, and of added ones that overlap
    each other the leftmost stays. precision: the share of loose proposals, among
    those of the calibrating half that score as high, whose content passes. Whole texts;
    null and empty ones have no spans. Repeated rows are each searched; an empty
    table gives an empty one; other columns are not read. No step shuffles texts
    or spans.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(proposals(docs, id_col=id_col, text_col=text_col, scratch=scratch), "proposals")
    picks = fitted(found, precision)
    v = lambda c: c["v"]

    def redact(c: Column) -> Column:
        out = F.lit(False)
        for k, (trees, margin) in picks.items():
            out = out | ((c["k"] == k) & (trees.column(v(c)) >= margin))
        return out

    spans = "array<struct<s:int,k:int,e:int>>"
    more = F.array_sort(F.transform(F.filter("loose", lambda c: (c.t == 3) & redact(c)), lambda c: F.struct(c.s.alias("s"), c.k.alias("k"), c.e.alias("e"))))
    found = found.withColumn("more", F.when(F.exists("loose", lambda c: c.t == 3), more).otherwise(F.array().cast(spans)))
    # of proposals that overlap each other the leftmost stays
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    keep = lambda a, c: F.when(c.s >= a.at, state(c.e, F.concat(a.out, F.array(c)))).otherwise(a)
    piece = lambda a, cs: _with(F.aggregate(cs, state(a.at, F.array().cast(spans)), keep), lambda r: state(r.at, F.concat(a.out, F.array(r.out))))
    apart = F.flatten(F.aggregate(_blocks(F.col("more")), state(F.lit(0), F.array().cast(f"array<{spans}>")), piece)["out"])
    found = found.withColumn("more", F.when(F.size("more") > 0, apart).otherwise(F.col("more")))
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(name, c.k + 1), c.s.cast("string"), c.e.cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda c: c.k == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_added"))


def proposals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, half, base, failed, loose): the base spans, the base matches that fail, and the loose proposals clear of base spans.

    half: by the text, so that copies of one fall together.
    """
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind in KINDS:
        for base in (True, False):
            x = _spans(x, kind, base)
    of = lambda base: F.concat(*[f"x{k}{base}" for k in range(len(KINDS))])
    x = x.select("id", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)).alias("half"), of(1).alias("strict"), of(0).alias("loose"))
    # written here, so that the plan of the patterns is not carried into that of the spans
    x = (scratch or Scratch(docs.sparkSession, "pii")).keep(x, "spans")
    x = x.withColumn("base", F.array_sort(F.filter("strict", lambda c: c.t == 2))).withColumn("failed", F.filter("strict", lambda c: c.t == 0)).drop("strict")
    # a base span before a proposal's end overlaps it if it ends after its start: base spans by start and proposals
    # by end in one order, and the running maximum of the base spans' ends
    event = lambda key, base, end, c: F.struct(key.alias("key"), base.alias("b"), end.alias("e"), c.alias("c"))
    none = F.lit(None).cast(_PROPOSALS[6:-1])
    events = F.array_sort(F.concat(F.transform("base", lambda c: event(c.s, F.lit(1), c.e, none)), F.transform("loose", lambda c: event(c.e, F.lit(0), F.lit(-1), c))))
    x = x.withColumn("events", F.when((F.size("base") > 0) & (F.size("loose") > 0), events))
    x = x.withColumn("upto", F.when(F.col("events").isNotNull(), _running(F.transform("events", lambda v: v.e), lambda a, v: F.greatest(a, v))))
    clear = F.transform(F.filter(F.arrays_zip("events", "upto"), lambda z: (z.events.b == 0) & (z.upto <= z.events.c.s)), lambda z: z.events.c)
    x = x.withColumn("loose", F.when(F.col("events").isNotNull(), clear).otherwise(F.col("loose"))).drop("events", "upto")
    known = F.transform("base", lambda c: F.struct(c.k.alias("k"), c.t.alias("t"), c.v.alias("v")))
    return x.withColumn("known", F.concat(known, *[F.transform(c, lambda c: F.struct(c.k.alias("k"), c.t.alias("t"), c.v.alias("v"))) for c in ("failed", "loose")])).select(
        "id", "half", F.transform("base", lambda c: F.struct(c.s.alias("s"), c.k.alias("k"), c.e.alias("e"))).alias("base"), "loose", "known"
    )


def fitted(found: DataFrame, precision: float) -> dict[int, tuple[Trees, float]]:
    """By kind: the trees of the first half, and the margin that the second half asks for."""
    known = found.select("half", F.explode("known").alias("c")).groupBy(F.col("c.k").alias("k"), "half", F.col("c.v").alias("v"))
    loose, passes = F.col("c.t").isin(1, 3), F.col("c.t") >= 2
    known = known.agg(F.count("*").alias("n"), F.count_if(passes).alias("p"), F.count_if(loose).alias("ln"), F.count_if(loose & passes).alias("lp")).collect()  # VECTORS a kind and half at most
    fit: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    rest: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in known:
        if r.half == 0:
            fit[r.k][r.v] = (r.n, r.p)
        elif r.ln:
            rest[r.k][r.v] = (r.ln, r.lp)
    out = {}
    for k in range(len(KINDS)):
        trees = Trees().fit(fit[k])
        cut = calibrate(trees, rest[k], precision)
        out[k] = (trees, math.log(cut / (1 - cut)) if cut < 1 else math.inf)
    return {k: (t, m) for k, (t, m) in out.items() if math.isfinite(m)}
