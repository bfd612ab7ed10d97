"""A score for abusive, hateful or sexual language in every document, and its rate in every source.

Each document becomes a few dense features: how dense the words of the lexicons are in it and in
its worst sentence, how near they stand to words for "you" and for groups, capitals, punctuation,
how many words are written so as to hide them, and the harmless contexts of machines, medicine and
rules. Gradient-boosted trees are trained on the rated documents, and an isotonic regression on the
rated documents held back turns their output into probabilities. Short examples made of the lexicons
take part in both, all together with the weight of SEED_WEIGHT ratings, and a bounded sample of the
documents without a rating as harmless ones, so that few ratings or none do too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import lexicon
from quernel.llm.lookalikes import skeleton
from quernel.session import settle

LABEL_ROWS = 20_000  # rated documents used for training, at most
SEED_WEIGHT = 20.0  # ratings that the examples from the lexicons count for, all together
UNRATED = 2_000  # documents without a rating, at most, that count as harmless, since few are not
UNRATED_WEIGHT = 5.0  # ratings that these count for, all together, each a twentieth at most
THRESHOLD = 0.5
ABUSE = ("INSULT", "THREAT", "HATE", "SEXUAL")
CONTEXT = ("SECOND_PERSON", "GROUP", "TECHNICAL", "MEDICAL", "RULES")
FEATURES = (
    *(f"worst {c}" for c in ABUSE), *(f"density {c}" for c in ABUSE), "worst hits", "worst phrases", "worst hidden", "worst second person", "worst group", "worst technical",
    "worst medical", "worst rules", "nearness of you", "worst capitals", "worst marks", "marks", "hidden words", "log length",
)

LEARNED = len(FEATURES) - 1  # the length only serves to place examples; how long a text is says nothing about it

_BOUND = re.compile(r"[.!?。！？\n]+")
_HIDES = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[@$!*][^\W\d_]|[^\W\d_][@$*0-9]|([^\W\d_])\1\1")
_LATIN = re.compile(r"[!-~À-ɏ]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_LEET = str.maketrans("013457@$!8", "oieastasib")
_SIGNS = re.compile(r"[^\w]|_")
_RUNS = re.compile(r"(.)\1{2,}")


class Words:
    """The lexicons in two Aho-Corasick machines, of abuse and of contexts."""

    def __init__(self):
        import ahocorasick

        self.abuse, self.context, self.plain, self.lengths = ahocorasick.Automaton(), ahocorasick.Automaton(), {}, {}
        entries: dict[str, list[tuple[int, bool]]] = {}
        for n, name in enumerate(ABUSE + CONTEXT):
            for w in re.split(r"[,\n]", getattr(lexicon, name)):
                if w := w.strip().casefold():
                    entries.setdefault(w.rstrip("*"), []).append((n, w.endswith("*")))
        for w, kinds in entries.items():
            for machine, own in ((self.abuse, [k for k in kinds if k[0] < len(ABUSE)]), (self.context, [k for k in kinds if k[0] >= len(ABUSE)])):
                if own:
                    machine.add_word(w, (len(w), own))
            if w[0] < "⺀" and " " not in w and len(w) >= 3 and any(n < len(ABUSE) for n, _ in kinds):
                self.plain[w] = [(n, open_) for n, open_ in kinds if n < len(ABUSE)]
                self.lengths.setdefault((w[0], len(w)), []).append(w)
        self.abuse.make_automaton()
        self.context.make_automaton()
        self.hidden = lru_cache(200_000)(self._hidden)

    def find(self, text: str, machine) -> Iterator[tuple[int, int, int]]:
        """(kind, start, words) of each entry that stands in the text as words of its own."""
        n = len(text)
        for end, (size, kinds) in machine.iter(text):
            start = end - size + 1
            if text[start] < "⺀" and start and text[start - 1].isalpha() and text[start].isalpha():
                continue
            part = text[end] < "⺀" and end + 1 < n and text[end + 1].isalpha() and text[end].isalpha()
            for kind, open_ in kinds:
                if open_ or not part:
                    yield kind, start, text.count(" ", start, end) + 1 if text[start] < "⺀" else size // 2

    def _hidden(self, token: str) -> int:
        """The kind of abuse that a token with signs, figures or repeated letters hides, or -1."""
        if not _HIDES.search(token):
            return -1
        if not token.isascii() and any(c > "⺀" for c in token):
            return max((self._unmask(w) for w in _LATIN.findall(token)), default=-1)
        return self._unmask(token.strip(".,;:?()[]{}\"'“”«»¿¡…—–`"))

    def _unmask(self, word: str) -> int:
        if "*" in word.strip("*"):
            bare = re.sub(r"[^\w*]", "", word)
            pattern = re.compile(re.escape(bare).replace(r"\*", r"\w"))
            for w in self.lengths.get((bare[:1], len(bare)), []) + self.lengths.get((bare[:1], len(bare) - 1), []):
                if pattern.fullmatch(w) or (bare.endswith("s") and pattern.fullmatch(w + "s")):
                    return self.plain[w][0][0]
        for form in {_SIGNS.sub("", word), _SIGNS.sub("", word.translate(_LEET)), _SIGNS.sub("", word.translate(_LEET).replace("1", "l"))}:
            for f in {form, _RUNS.sub(r"\1", form), _RUNS.sub(r"\1\1", form)}:
                if f == word:
                    continue
                for end in (len(f), len(f) - 1):  # also a plural
                    if (kinds := self.plain.get(f[:end])) and (end == len(f) or f.endswith(("s", "n", "x")) or kinds[0][1]):
                        return kinds[0][0]
                for cut in range(4, len(f)):
                    if (kinds := self.plain.get(f[:cut])) and kinds[0][1]:
                        return kinds[0][0]
        return -1


_words: list[Words] = []


def features(text: str | None) -> list[float]:
    """The dense features of one text, all 0 for a null or empty one."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    if not _words:
        _words.append(Words())
    words = _words[0]
    shown = re.sub(r"[ \t]+", " ", skeleton(text))
    low = shown.casefold()
    if len(low) != len(shown):  # a letter that folds to two
        low = shown.lower() if len(shown.lower()) == len(shown) else "".join(c.lower() if len(c.lower()) == 1 else c for c in shown)
    n = max(1, len(low))
    abuse = [(k, s, w, False) for k, s, w in words.find(low, words.abuse)]
    hidden = 0
    for token in [*set(low.split()), *_SPACED.findall(low)]:
        if (k := words.hidden(token)) >= 0:
            hidden += 1
            abuse.append((k, low.find(token), 1, True))
    found = list(words.find(low, words.context)) if abuse else []
    out = dict.fromkeys(FEATURES, 0.0)
    out["marks"] = sum(map(low.count, "!?*$@")) / n
    out["hidden words"], out["log length"] = hidden / n * 1000, float(np.log1p(n))
    you = [s for k, s, _ in found if k == len(ABUSE)]
    if abuse:
        edges = [0, *(m.end() for m in _BOUND.finditer(low)), n + 1]
        place = lambda s: bisect_right(edges, s) - 1
        by: dict[int, dict] = {}
        for k, s, w, h in abuse:
            v = by.setdefault(place(s), {"kinds": [0] * len(ABUSE), "starts": set(), "phrases": 0, "hidden": 0, "context": [0] * len(CONTEXT)})
            if s not in v["starts"]:
                v["kinds"][k] += 1
            v["starts"].add(s)
            v["phrases"] += w >= 2
            v["hidden"] += h
        for k, s, _ in found:
            if k >= len(ABUSE) and (v := by.get(place(s))):
                v["context"][k - len(ABUSE)] += 1
        weigh = lambda v: len(v["starts"]) + 1.5 * v["phrases"] + v["hidden"] + 0.5 * (v["context"][0] > 0) + 0.5 * (v["context"][1] > 0) - sum(v["context"][2:])
        for k, name in enumerate(ABUSE):  # sentences about machines, medicine or rules don't count
            out[f"density {name}"] = sum(v["kinds"][k] for v in by.values() if len(v["starts"]) > sum(v["context"][2:])) / n * 1000
        at = max(by, key=lambda i: weigh(by[i]))
        v, part = by[at], shown[edges[at] : edges[at + 1]]
        for k, name in enumerate(ABUSE):
            out[f"worst {name}"] = max(0.0, float(v["kinds"][k] - sum(v["context"][2:])))
        out["worst hits"], out["worst phrases"], out["worst hidden"] = max(0.0, float(len(v["starts"]) - sum(v["context"][2:]))), float(v["phrases"]), float(v["hidden"])
        for name, x in zip(("second person", "group", "technical", "medical", "rules"), v["context"]):
            out[f"worst {name}"] = float(x)
        near = min((abs(s - y) for s in v["starts"] for y in you if place(y) == at), default=200)
        out["nearness of you"] = 1 / (1 + near / 10)
        big = [c for c in part if c.isalpha()]
        out["worst capitals"] = sum(c.isupper() for c in big) / max(1, len(big))
        out["worst marks"] = sum(map(part.count, "!?*$@")) / max(1, len(part))
    return [out[f] for f in FEATURES]


@lru_cache(1)
def seeds() -> list[tuple[list[float], float]]:
    """(features, label) of examples made of the lexicons: two words of abuse, said to somebody or not, or a phrase of it; the words alone, or in a harmless context."""
    entries = lambda name: [[w for x in line.split(",") if (w := x.strip().rstrip("*"))] for line in getattr(lexicon, name).strip().split("\n")]
    you, harmless, out = entries("SECOND_PERSON")[0], [w for c in CONTEXT[2:] for line in entries(c) for w in line], []
    for name in ABUSE:
        for line in entries(name):
            for i, (w, other) in enumerate(zip(line, line[1:] + line[:1])):
                out.append((f"{you[i % len(you)]} {w} {other}" if i % 2 else f"{w} {other}", 1.0))
                out.append((w, float(" " in w)))
                out.append((f"{harmless[i % len(harmless)]} {w} {harmless[(7 * i + 3) % len(harmless)]}.", 0.0))
    return [(features(x.capitalize()), label) for x, label in [*out, ("", 0.0)]]


def placed(x: list[float], document: list[float]) -> list[float]:
    """The features of an example as if it stood in a document of the length and marks of another, of 300 characters at least."""
    own, whole = dict(zip(FEATURES, x)), dict(zip(FEATURES, document))
    whole["log length"] = max(whole["log length"], float(np.log1p(300)))
    thinner = max(1.0, np.expm1(own["log length"])) / max(1.0, np.expm1(own["log length"]) + np.expm1(whole["log length"]))
    thin = {f: v * thinner for f, v in own.items() if f.startswith("density") or f == "hidden words"}
    return [float(v) for v in (own | thin | {f: whole[f] for f in ("marks", "log length")}).values()]


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, x) for each row of documents(doc_id, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "source", "x"])

    slim = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, source string, x array<double>")


def scores(documents: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, trees: int = 20, depth: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, source, score) for each row of documents; labels(doc_id, toxic) are ratings of some of them.

    A document with several ratings has their mean; even ones are left out of training, as are null
    ratings. A null, empty or blank text scores what a text without any such words does. With few
    ratings the examples of ``seeds`` decide, with many the ratings; the method is the same.
    """
    whole = settle(measured(documents), "features")
    rated = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("toxic").alias("mean")).where("mean != 0.5")
    few = rated.orderBy(F.xxhash64("doc_id")).limit(label_rows).join(whole.select("doc_id", "x").dropDuplicates(["doc_id"]), "doc_id")
    few = few.select("doc_id", (F.col("mean") > 0.5).cast("double").alias("label"), "x", F.lit(1.0).alias("weight"))
    rest = whole.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(rated.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id")).limit(UNRATED).select("doc_id", "x")
    unrated = [(r["doc_id"], r["x"]) for r in rest.collect()]  # bounded by UNRATED
    made = [(-1 - i, label, placed(x, unrated[i % len(unrated)][1] if unrated else [0.0] * len(FEATURES)), SEED_WEIGHT / len(seeds())) for i, (x, label) in enumerate(seeds())]
    made += [(i, 0.0, x, min(UNRATED_WEIGHT / len(unrated), 0.05)) for i, x in unrated]
    few = few.unionByName(documents.sparkSession.createDataFrame(made, "doc_id bigint, label double, x array<double>, weight double"))
    few = few.withColumn("features", array_to_vector(F.slice("x", 1, LEARNED))).drop("x").coalesce(2).cache()
    held = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) == 0
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, weightCol="weight", seed=seed).fit(few.where(~held))
    share = vector_to_array("probability")[1].alias("share")
    isotonic = IsotonicRegression(featuresCol="share", weightCol="weight").fit(model.transform(few.where(held)).select("label", share, "weight"))
    few.unpersist()
    raw = model.transform(whole.select("doc_id", "source", array_to_vector(F.slice("x", 1, LEARNED)).alias("features"))).select("doc_id", "source", share)
    return isotonic.transform(raw).select("doc_id", "source", F.col("prediction").alias("score"))


def flagged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id) of the documents whose score reaches the threshold, each once."""
    return scored.where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate) for each source, a null source being one."""
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))
