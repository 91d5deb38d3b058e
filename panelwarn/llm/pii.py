"""Personal data (operator 1): labelers vote, EM weighs them, a trained classifier decides.

Everything runs in DataFrame functions.  Regular expressions propose candidate
spans; on each candidate four labelers vote no, nothing or yes: the strict
form (ranges, digit counts, checksum), a gazetteer (domains, address blocks,
card issuers, country codes, first names), the words to its left, and the
characters around it.  Expectation-maximisation over the table of vote
patterns (a few hundred rows at most, whatever the corpus) estimates each
labeler's reliability and a probability for each pattern, with no labels.
These probabilities train the final classifier, a naive Bayes model over the
votes and the span's shape (length, digits, neighbours), again on one
aggregate.  Base spans (the strict forms) always stay; the classifier adds
the others that it gives ``THRESHOLD`` or more and that overlap no base span.
Secrets (tokens, keys) are long strings of letters and digits, candidates only;
they may hold a base span, such as a run of digits, and are added whole.

Positions are code points, end exclusive.  They come from splitting a text at
the matches: running sums over the lengths of pieces and matches, taken by
doubling, so that a text with many matches costs n log n.  Possessive
quantifiers and look-behinds keep the patterns linear and free of recursion;
``\\G`` allows a match right after the last one.

Defined results.  A null text is empty: no spans, and the digest of the empty
string.  Repeated rows and null doc_ids give a row each.  An empty table
leaves the priors as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, saved

THRESHOLD = 0.9
ROUNDS = 8
KINDS = ("email", "ip", "card", "phone", "name", "secret")
LABELERS = ("strict", "listed", "context", "edges")
SHAPES = ("size", "digits", "prev", "next")
NO, NONE, YES = 0, 1, 2

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (what a text must contain, base pattern)
BASE = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Looser forms, candidates only.
LOOSE = {
    "email": (r"(?i)[(\[]at[)\]]", r"(?i)(?<![a-z0-9])[a-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[a-z0-9-]{1,64}+"
                                   r"(?: ?[(\[]dot[)\]] ?[a-z0-9-]{1,64}+|\.[a-z0-9-]{1,64}+)"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])"),
    "phone": (r"[0-9]{3}[) .-]", r"(?<![0-9+).-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "name": (r"(?:Mr|Mrs|Ms|Dr|Prof|[Nn]ame)", r"(?:(?<=Mr |Ms |Dr |Mr\. |Ms\. |Dr\. |Mrs |Mrs\. |Prof |Prof\. |ame: |ame is ))"
                                               r"[A-Z][a-z]{1,30}+ [A-Z][a-z]{1,30}+"),
    "secret": (r"[A-Za-z0-9_+/-]{20}", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}+[0-9])(?=[0-9_+/-]{0,64}+[A-Za-z])"
                                       r"[A-Za-z0-9_+/-]{20,512}+(?![A-Za-z0-9_+/-])"),
}
#: Gazetteers of the listed-labeler, and context words.
DOMAINS = ("com org net edu gov mil int info biz io de fr es it nl be ch at uk us ca au jp cn in br ru pl se no fi dk "
           "pt ie eu").split()
COUNTRIES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
             "81 82 84 86 90 91 92 93 94 95 98").split()
NAMES = ("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph "
         "jessica thomas sarah charles karen anna maria peter paul hans julia pierre marie jean luis carmen jose ana").split()
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
#: Forms of digests and of keys that services hand out.
_KEYS = (r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_\w++|xox[abprs]-.++|sk_(?:live|test)_\w++"
         r"|eyJ.++)$")
_NEAR = {
    "email": r"mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|client|from",
    "card": r"card|visa|master|amex|credit|paid", "phone": r"call|phone|tel|fax|mobile|dial|contact|reach",
    "name": r"mr|mrs|ms|dr|prof|name", "secret": r"token|secret|passw|credential|bearer|auth|key",
}
_AWAY = r"version|isbn|order|invoice|page|chapter|price|release|section|serial"


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination along an array, by doubling."""
    doublings = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1

    def double(done: Column, step: Column) -> Column:
        back = F.pow(F.lit(2), step).cast("int")
        return F.transform(done, lambda x, i: F.when(i >= back, combine(x, F.get(done, i - back))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), doublings), values, double)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once (a lambda evaluates what it mentions for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, needs: str, pattern: str) -> Column:
    """start, end, found, left and right of every match."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    has = F.contains(text, F.lit(needs)) if needs == "@" else F.rlike(text, F.lit(needs))
    both = F.when(has, F.struct(found.alias("m"), pieces.alias("p")))

    def located(b: Column) -> Column:
        m, p = b["m"], b["p"]
        sums = _scan(F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("int")), lambda x, y: x + y)
        return _let(sums, lambda ends: F.transform(m, lambda x, i: F.struct(
            (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("found"),
            F.right(F.get(p, i), F.lit(24)).alias("left"), F.left(F.get(p, i + 1), F.lit(1)).alias("right"))))

    return _let(both, lambda b: F.when(b.isNotNull() & (F.size(b["m"]) > 0), located(b)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string (not empty) passes the Luhn check."""
    turned = F.reverse(digits)

    def share(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), share), F.lit(0), lambda a, d: a + d) % 10 == 0


def _strict(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
        return F.rlike(found, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _listed(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lower(F.regexp_extract(found, r"([A-Za-z]+)[^A-Za-z]*$", 1)).isin(DOMAINS)
    if kind == "ip":
        return ~F.rlike(found, F.lit(r"^(?:0|127|255)\.|^[0-9](?:\.[0-9]){3}$"))
    if kind == "card":
        return F.rlike(_digits(found), F.lit(_ISSUER))
    if kind == "phone":
        return F.rlike(_digits(found), F.lit(f"^(?:{'|'.join(COUNTRIES)})"))
    if kind == "secret":
        return F.rlike(found, F.lit(_KEYS))
    return F.lower(F.regexp_extract(found, r"^([A-Za-z]+)", 1)).isin(NAMES)


def _neighbour(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).when(F.rlike(c, F.lit("[A-Za-z0-9]")), 1).when(F.rlike(c, F.lit(r"\s")), 2).otherwise(3)


def _candidates(text: Column, kind: str, needs: str, pattern: str, base: bool) -> Column:
    vote = lambda c: F.when(c, YES).otherwise(NO)

    def judged(m: Column) -> Column:
        found, left = m["found"], F.lower(m["left"])
        strict = _strict(kind, found) if base else F.lit(None).cast("boolean")
        prev, after = _neighbour(F.right(m["left"], F.lit(1))), _neighbour(m["right"])
        context = F.when(F.rlike(left, F.lit(_AWAY)), NO).when(F.rlike(left, F.lit(_NEAR[kind])), YES).otherwise(NONE)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            F.coalesce(strict, F.lit(False)).alias("base"),
            F.coalesce(vote(strict) if base else F.lit(NONE), F.lit(NONE)).alias("strict"),
            vote(_listed(kind, found)).alias("listed"), context.alias("context"),
            vote((prev != 1) & (after != 1)).alias("edges"),
            F.least(F.floor(F.length(found) / 4), F.lit(8)).cast("int").alias("size"),
            F.floor(F.length(_digits(found)) * 4 / F.length(found)).cast("int").alias("digits"),
            prev.alias("prev"), after.alias("next"))

    return F.transform(_matches(text, needs, pattern), judged)


_CANDIDATE = ("array<struct<kind:string,start:int,end:int,base:boolean,strict:int,listed:int,context:int,edges:int,"
              "size:int,digits:int,prev:int,next:int>>")


def find_candidates(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns and ``candidates`` (array of spans with votes and shape) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(docs, *dict.fromkeys([*carry, "text"]))
    none = F.array().cast(_CANDIDATE)
    lists = [_candidates(text, k, *BASE[k], True) for k in BASE] + [_candidates(text, k, *LOOSE[k], False) for k in LOOSE]
    rows = rows.withColumns({f"_c{i}": c.cast(_CANDIDATE) for i, c in enumerate(lists)})
    return rows.select(*carry, F.concat(*[F.coalesce(f"_c{i}", none) for i in range(len(lists))]).alias("candidates"))


class Reliability:
    """P(vote | truth) of each labeler and P(personal) of each kind."""

    #: Dirichlet counts of (no, none, yes) for false and true candidates.
    PRIOR = ((6.0, 3.0, 1.0), (1.0, 3.0, 6.0))

    def __init__(self) -> None:
        self.kinds = dict.fromkeys(KINDS, 0.5)
        self.votes = {l: [[c / 10 for c in self.PRIOR[y]] for y in (0, 1)] for l in LABELERS}

    def log_odds(self) -> Column:
        parts = [_choose(F.col("kind"), {k: math.log(p / (1 - p)) for k, p in self.kinds.items()})]
        parts += [_choose(F.col(l), {v: math.log(t[1][v] / t[0][v]) for v in (NO, NONE, YES)}) for l, t in self.votes.items()]
        return sum(parts[1:], parts[0])


def _choose(c: Column, values: dict) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(c == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """EM over the counts ``n`` of vote patterns (kind and one column a labeler)."""
    model = Reliability()
    for _ in range(rounds):
        weighed = patterns.withColumn("p", 1 / (1 + F.exp(-model.log_odds())))
        sums = []
        for y, share in ((0, 1 - F.col("p")), (1, F.col("p"))):
            for l in LABELERS:
                sums += [F.sum(F.when(F.col(l) == v, F.col("n") * share).otherwise(0.0)).alias(f"{l}{y}{v}") for v in (NO, NONE, YES)]
            sums += [F.sum(F.when(F.col("kind") == k, F.col("n") * share).otherwise(0.0)).alias(f"{k}{y}") for k in KINDS]
        got = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}
        for l in LABELERS:
            for y in (0, 1):
                counts = [got[f"{l}{y}{v}"] + model.PRIOR[y][v] for v in (NO, NONE, YES)]
                model.votes[l][y] = [c / sum(counts) for c in counts]
        model.kinds = {k: (got[f"{k}1"] + 2) / (got[f"{k}0"] + got[f"{k}1"] + 4) for k in KINDS}
    return model


class SpanClassifier:
    """Naive Bayes over votes and shape, trained on EM's probabilities."""

    def __init__(self, tables: dict[str, dict], kinds: dict[str, float]):
        self.tables, self.kinds = tables, kinds

    @classmethod
    def train(cls, spans: DataFrame, model: Reliability) -> SpanClassifier:
        """``spans``: kind, labelers, shapes and the count ``n`` of each combination."""
        features = [*LABELERS, *SHAPES]
        weighed = spans.withColumn("p", 1 / (1 + F.exp(-model.log_odds())))
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features])).alias("x")
        # at most a few values a feature
        rows = weighed.select(pairs, "n", "p").groupBy("x.f", "x.v").agg(
            F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
        tables: dict[str, dict] = {f: {} for f in features}
        for f in features:
            mine = [r for r in rows if r["f"] == f]
            prior = [(model.PRIOR[1][v], model.PRIOR[0][v]) for v in (NO, NONE, YES)] if f in LABELERS else None
            values = sorted({r["v"] for r in mine} | ({NO, NONE, YES} if prior else set()))
            add = {v: prior[v] if prior else (1.0, 1.0) for v in values}
            got = {r["v"]: (r["yes"], r["no"]) for r in mine}
            both = {v: [got.get(v, (0.0, 0.0))[i] + add[v][i] for i in (0, 1)] for v in values}
            total = [sum(b[i] for b in both.values()) for i in (0, 1)]
            tables[f] = {v: math.log(b[0] / total[0]) - math.log(b[1] / total[1]) for v, b in both.items()}
        return cls(tables, model.kinds)

    def probability(self, span: Column) -> Column:
        parts = [_choose(span["kind"], {k: math.log(p / (1 - p)) for k, p in self.kinds.items()})]
        parts += [_choose(span[f], t) for f, t in self.tables.items()]
        return 1 / (1 + F.exp(-sum(parts[1:], parts[0])))


def fit_spans(found: DataFrame) -> SpanClassifier:
    """Reliabilities by EM, then the classifier, from the candidates of a whole corpus."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    combos = saved(spans.groupBy("kind", *LABELERS, *SHAPES).agg(F.count(F.lit(1)).alias("n")), "pii-spans")
    patterns = saved(combos.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).coalesce(1), "pii-votes")
    return SpanClassifier.train(combos, estimate(patterns))


def _chosen(classifier: SpanClassifier, threshold: float) -> Column:
    """The final spans of ``candidates``: base ones, and added ones that overlap none of them (secrets may)."""
    base = F.filter("candidates", lambda c: c["base"])
    likely = F.filter("candidates", lambda c: ~c["base"] & (classifier.probability(c) >= threshold))
    meets = lambda own, c: F.exists(own, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    clear = lambda own: F.filter(likely, lambda c: (c["kind"] == "secret") | ~meets(own, c))
    return _let(base, lambda own: F.concat(own, clear(own)))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda c: c["kind"] == kind)


def _places(spans: Column, kind: str) -> Column:
    places = F.transform(_of_kind(spans, kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    return F.transform(F.array_sort(places), lambda c: F.concat_ws(":", F.lit(kind), c["start"], c["end"]))


def _written(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start, comma-joined."""
    return F.array_join(F.concat(*[_places(spans, kind) for kind in KINDS]), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row."""
    found = saved(find_candidates(docs, ("doc_id",)), "pii")
    classifier = fit_spans(found)
    base = F.filter("candidates", lambda c: c["base"])
    counts = [F.size(_of_kind(base, k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
                        _written(_chosen(classifier, threshold)).alias("spans"))


_CHUNK = 10_000


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with every span (merged where they overlap) replaced by its kind in brackets.

    The text is taken in chunks, so that cutting out a piece never walks the whole text.
    """
    spans = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"),
                                                               c["kind"].alias("kind"))))
    whole = F.struct(spans.alias("s"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)).alias("chunks"),
                     F.length(text).alias("n"))

    def rewritten(w: Column) -> Column:
        s, chunks = w["s"], w["chunks"]
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")
            cut = F.transform(F.sequence(first, last), lambda i: F.substr(
                F.get(chunks, i), F.greatest(a - i * _CHUNK, F.lit(0)) + 1,
                F.least(b - i * _CHUNK, F.lit(_CHUNK)) - F.greatest(a - i * _CHUNK, F.lit(0))))
            return F.when(b > a, F.array_join(cut, "")).otherwise("")

        def joined(reach: Column) -> Column:
            def part(c: Column, i: Column) -> Column:
                before = F.coalesce(F.get(reach, i - 1), F.lit(0))
                tag = F.concat(piece(before, c["start"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))
                return F.when(c["start"] >= before, tag).otherwise("")

            tail = F.coalesce(F.get(reach, F.size(s) - 1), F.lit(0))
            return F.concat(F.array_join(F.transform(s, part), ""), piece(tail, w["n"]))

        return _let(_scan(F.transform(s, lambda c: c["end"]), lambda x, y: F.greatest(x, y)), joined)

    return _let(whole, rewritten)


def mask_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, if there, counted anew."""
    columns = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(columns) if c != "text"}
    found = saved(find_candidates(docs.withColumnsRenamed(inner), tuple(inner.get(c, c) for c in columns)), "pii-texts")
    spans = _chosen(fit_spans(found.select("candidates")), threshold)
    text = F.when(F.size(spans) > 0, _masked(F.col("text"), spans)).otherwise(F.col("text"))
    masked = found.withColumn("text", text)
    out = masked.select(*[F.col(inner.get(c, c)).alias(c) for c in columns])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
