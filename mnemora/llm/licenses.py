"""Licence scans: a trained paragraph classifier whose predictions templates must confirm.

Sparse multinomial logistic regression over word 1-, 2- and 3-grams tells licence families from an
explicit class "unknown", which is trained on prose about rights, on licences of other families and on
sentences that deny, cite or compare a licence. Features are taken near a licence term only, so a paragraph
without one has no evidence and is unknown by construction: such paragraphs are passed over after one
search of the text, and this changes no result. Probabilities are calibrated on wordings not trained on
(temperature, and the threshold that loses the fewest of them). A predicted paragraph counts only if it
holds enough of the word pairs of one of the family's templates.

Training takes the paragraphs in ``license_texts`` (a fixed set of some thousand rows), runs on the
driver in some seconds, and takes no row of any table. The scan itself is one narrow pass of DataFrame
functions: the model is three constants of the plan.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import (
    CALIBRATION_DENIALS, CALIBRATION_NOTICES, DENIALS, HEADINGS, HELD_OUT_FRAMES, KEYS, NAMES, SHORT_FORMS, SPDX, TEMPLATES, TRAIN_FRAMES, UNKNOWN, UNKNOWN_SHORT,
)

UNKNOWN_CLASS = "unknown"
#: Licence terms, as patterns for the start of a word: words further than ``near`` from one are no features.
TERMS = (
    "licen[cs]", "unlicen[cs]", "copyright", "spdx", "gnu", "gpl", "lgpl", "agpl", "bsd", "mpl", "apache", "mozilla", "cc0?(?![a-z0-9])", "rights",
    "redistribut", "public", "creative", "permission"
)
#: A version loses its word and its "v", and stands apart from a name: GPLv3, GPL-3.0 and GPL version 3 are alike.
_VERSION = r"(?:(?<=gpl)|(?<=mpl)|(?<=asl)|(?<=apache)|(?<![a-z0-9]))[\s(,]*(?:version|v)\.?\s*(?=[0-9])|(?<=gpl)(?=[0-9])"
_TOKEN = r"attribution(?:-[a-z]+)+|[a-z0-9]+(?:\.[a-z0-9]+)*"
_NUMBER = r"^[0-9]+(?:\.[0-9]+)*$"
_TERM_START = "|".join(TERMS)


@dataclass(frozen=True)
class LicenseRules:
    """``l1``: weight of the sparsity penalty; ``near``: words around a licence term that are features;
    ``similarity``: share of a template's word pairs that confirms; ``false_weight``: how much more than a
    missed notice a passed denial weighs when the threshold is chosen; ``run_lines``: lines joined to find wrapped notices.
    """

    l1: float = 0.0002
    rounds: int = 160
    near: int = 5
    similarity: float = 0.6
    false_weight: float = 3.0
    run_lines: tuple[int, ...] = (4, 8, 16)


def tokens(text: str) -> list[str]:
    return ["#" if re.match(_NUMBER, t) else t for t in re.findall(_TOKEN, re.sub(_VERSION, " ", text.lower()))]


def grams(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


_TERM = re.compile(rf"(?:{_TERM_START})")


def features(text: str, near: int) -> set[str]:
    """N-grams of adjacent words that all lie within ``near`` words of a licence term."""
    words = tokens(text)
    at = [i for i, w in enumerate(words) if _TERM.match(w)]
    close = {j for i in at for j in range(max(0, i - near), min(len(words), i + near + 1))}
    return {g for g in grams([w if i in close else "" for i, w in enumerate(words)]) if not ("  " in f" {g} " or g == "")}


@dataclass(frozen=True)
class LicenseModel:
    near: int
    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias)
        for g in sorted(features(text, self.near) & self.weights.keys()):
            z = z + np.array(self.weights[g])
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        p = self.probabilities(text)
        k = int(p.argmax())
        return (self.classes[k] if k and p[k] >= self.threshold else UNKNOWN_CLASS), float(p[k])


def _labelled(frames: tuple[str, ...]) -> list[tuple[str, str]]:
    known = [(f, frame.format(t)) for f, ts in TEMPLATES.items() for t in ts for frame in frames]
    return known + [(UNKNOWN_CLASS, frame.format(t)) for t in UNKNOWN for frame in frames]


def filled(forms: tuple[str, ...], spdx: bool = True) -> list[tuple[str, str]]:
    """``(family, sentence)``: each form with each name, and identifier, of each family."""
    every = {f: (*NAMES[f], *SPDX[f]) if spdx else NAMES[f] for f in NAMES}
    return sorted({(f, form.replace("{}", n)) for f, names in every.items() for n in names for form in forms})


@lru_cache(maxsize=1)
def _short_rows() -> list[tuple[str, str]]:
    """Short notices and denials to train on, one of each token sequence."""
    rows = filled(SHORT_FORMS, spdx=False) + filled(KEYS[:2])
    stated = [(f, f"SPDX-License-Identifier: {x}") for f, xs in SPDX.items() for x in xs]
    rows += [(f, t) for f, ts in HEADINGS.items() for t in ts]
    rows += [(UNKNOWN_CLASS, t) for _, t in filled(DENIALS, spdx=False)]
    rows = list({(f, *tokens(t)): (f, t) for f, t in rows}.values()) + 4 * stated
    return rows + [(UNKNOWN_CLASS, t) for t in UNKNOWN_SHORT for _ in range(4)]


def _calibration_rows() -> list[tuple[str, str]]:
    """Wordings that training doesn't see, known and unknown in equal number or nearly so."""
    return _labelled(HELD_OUT_FRAMES) + filled(CALIBRATION_NOTICES, spdx=False) + [
        (UNKNOWN_CLASS, t) for _, t in filled(CALIBRATION_DENIALS, spdx=False)
    ]


@lru_cache(maxsize=1)
def _template_pairs() -> dict[str, list[list[str]]]:
    """Word pairs of each family's templates and headings, and of its keys, which are so short that nearly all must be held."""
    keys = filled((*KEYS, "identifier {}"))
    every = {f: [*ts, *(t for g, t in keys if g == f), *HEADINGS.get(f, ())] for f, ts in TEMPLATES.items()}
    return {f: sorted({tuple(sorted(grams(tokens(t), (2,)))) for t in ts if len(tokens(t)) > 1}) for f, ts in every.items()}


@lru_cache(maxsize=4)
def train(rules: LicenseRules = LicenseRules()) -> LicenseModel:
    rows = _labelled(TRAIN_FRAMES) + _short_rows()
    classes = (UNKNOWN_CLASS, *TEMPLATES)
    found = [features(text, rules.near) for _, text in rows]
    held_by = Counter(g for gs in found for g in gs)
    vocabulary = sorted(g for g, n in held_by.items() if n > 1)
    at = {g: j for j, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, gs in enumerate(found):
        x[i, [at[g] for g in gs if g in at]] = 1.0
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(f) for f, _ in rows]]
    importance = (y / y.mean(axis=0)).sum(axis=1, keepdims=True) / len(classes)  # every class weighs the same
    importance[y[:, 0] > 0] *= 2  # and "unknown" as much as two, for its many kinds
    importance = (importance / importance.mean()).astype(np.float32)
    w, b = np.zeros((len(vocabulary), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    b[0] = 2.0  # without evidence a paragraph is unknown; the bias stays fixed
    v = np.ones(len(vocabulary), dtype=np.float32)
    for _ in range(20):  # largest eigenvalue by the power method
        v = x.T @ (importance[:, 0] * (x @ v))
        v /= (size := np.linalg.norm(v))
    step = np.float32(2 * len(rows) / (1.05 * size))
    previous, t = w, 1.0
    for _ in range(rules.rounds):  # accelerated proximal gradient
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = w + np.float32((t - 1) / t_next) * (w - previous)
        z = x @ ahead + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        moved = ahead - step * (x.T @ (importance * (p - y)) / np.float32(len(rows)))
        previous, w, t = w, np.sign(moved) * np.maximum(np.abs(moved) - step * np.float32(rules.l1), 0), t_next
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 1e-3)
    weights = {vocabulary[j]: tuple(round(float(a), 4) for a in w[j]) for j in used}
    plain = LicenseModel(rules.near, classes, weights, tuple(map(float, b)), 1.0, 0.0)
    held = [(classes.index(f), np.log(np.maximum(plain.probabilities(text), 1e-300))) for f, text in _calibration_rows()]

    def loss(temperature: float) -> float:
        total = 0.0
        for k, z in held:
            s = z / temperature
            total -= s[k] - (s.max() + math.log(np.exp(s - s.max()).sum()))
        return total

    temperature = min((0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0), key=loss)
    sure = LicenseModel(rules.near, classes, weights, plain.bias, temperature, 0.0)
    seen = [(f, *_best(sure.probabilities(text), classes)) for f, text in _calibration_rows()]

    def cost(threshold: float) -> float:
        """What calibration rows lose at a threshold: notices missed and, weighing as stated, others that pass."""
        missed = [p < threshold or g != f for f, g, p in seen if f != UNKNOWN_CLASS]
        passed = [g != UNKNOWN_CLASS and p >= threshold for f, g, p in seen if f == UNKNOWN_CLASS]
        return sum(missed) / len(missed) + rules.false_weight * sum(passed) / len(passed)

    return LicenseModel(rules.near, classes, weights, plain.bias, temperature, min((x / 100 for x in range(50, 96)), key=cost))


def _best(p: np.ndarray, classes: tuple[str, ...]) -> tuple[str, float]:
    k = int(p.argmax())
    return classes[k], float(p[k])


def _constant(value: object, kind: str) -> Column:
    """A literal of any type: a constant expression, folded once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(
        F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def _tokens(text: Column) -> Column:
    """:func:`tokens` as an expression."""
    return F.transform(
        F.regexp_extract_all(F.regexp_replace(F.lower(text), _VERSION, " "), F.lit(_TOKEN), 0), lambda w: F.when(w.rlike(_NUMBER), "#").otherwise(w)
    )


def _near_terms(words: Column, near: int) -> Column:
    """The words with "" in place of those further than ``near`` from a licence term: no n-gram with a gap is in the vocabulary."""
    start = lambda i: F.greatest(i - near, F.lit(0)) + 1
    around = lambda i: F.slice(words, start(i), i + near + 2 - start(i))
    return F.transform(words, lambda w, i: F.when(F.exists(around(i), lambda x: x.rlike(f"^(?:{_TERM_START})")), w).otherwise(""))


def _confirmed(candidates: Column, model: LicenseModel, rules: LicenseRules) -> Callable[[DataFrame], DataFrame]:
    """Replaces ``candidates`` (structs of paragraph, lines, text) in column ``p`` by those the model and a template of its family accept."""
    weights = _constant({g: list(v) for g, v in model.weights.items()}, "map<string,array<double>>")
    vocabulary = _constant(sorted(model.weights), "array<string>")
    pairs = _constant({f: list(map(list, ts)) for f, ts in _template_pairs().items()}, "map<string,array<array<string>>>")
    classes = F.array(*map(F.lit, model.classes))
    own = lambda p: (p["paragraph"].alias("paragraph"), p["lines"].alias("lines"), p["text"].alias("text"))
    evidence = lambda p: F.array_intersect(F.concat(_grams(p["close"], 1), _grams(p["close"], 2), _grams(p["close"], 3)), vocabulary)
    logits = lambda p: F.aggregate(p["f"], F.array(*map(F.lit, model.bias)), lambda z, g: F.zip_with(z, F.element_at(weights, g), lambda a, b: a + b))
    best = lambda p: F.element_at(classes, F.array_position(p["z"], F.array_max(p["z"])).cast("int"))
    sure = lambda p: 1 / F.aggregate(p["z"], F.lit(0.0), lambda s, z: s + F.exp((z - F.array_max(p["z"])) / model.temperature))
    alike = lambda p: F.array_max(F.transform(F.element_at(pairs, p["family"]), lambda t: F.size(F.array_intersect(t, p["pairs"])) / F.size(t)))

    def run(step: DataFrame) -> DataFrame:
        step = step.withColumn("p", F.transform(candidates, lambda p: F.struct(*own(p), _tokens(p["text"]).alias("words"))))
        step = step.withColumn(
            "p", F.transform("p", lambda p: F.struct(*own(p), p["words"].alias("words"), _near_terms(p["words"], rules.near).alias("close")))
        )
        step = step.withColumn("p", F.transform("p", lambda p: F.struct(*own(p), p["words"].alias("words"), evidence(p).alias("f"))))
        step = step.withColumn("p", F.transform("p", lambda p: F.struct(*own(p), p["words"].alias("words"), logits(p).alias("z"))))
        step = step.withColumn(
            "p",
            F.transform(
                "p",
                lambda p: F.struct(
                    *own(p), F.array_distinct(_grams(p["words"], 2)).alias("pairs"), best(p).alias("family"), sure(p).alias("probability")
                )
            )
        )
        step = step.withColumn("p", F.filter("p", lambda p: (p["family"] != UNKNOWN_CLASS) & (p["probability"] >= model.threshold)))
        step = step.withColumn(
            "p",
            F.transform(
                "p",
                lambda p: F.struct(
                    p["paragraph"].alias("paragraph"), p["lines"].alias("lines"), p["family"].alias("family"), p["probability"].alias("probability"),
                    alike(p).alias("similarity"), p["text"].alias("text")
                )
            )
        )
        return step.withColumn("p", F.filter("p", lambda p: p["similarity"] >= rules.similarity))

    return run


def _runs(lines: Column, alone: Column, term: str, sizes: tuple[int, ...]) -> Column:
    """Runs of adjacent lines, joined, that hold a term: of each size, a new one every half size.

    A run stops at a line without a word and at a line that is a notice by itself (its number in ``alone``),
    so a notice of up to half a size and one lines lies whole in one of them.
    """
    open_ = lambda x: x["text"].rlike("(?i)[a-z0-9]") & ~F.array_contains(alone, x["paragraph"])

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0)), F.lit(size // 2))
        window = F.flatten(F.transform(starts, lambda i: _pieces(F.slice(lines, i + 1, size), open_)))
        return F.filter(window, lambda p: (p["lines"] > 1) & p["text"].rlike(term))

    return F.concat(*map(of, sizes))


def _pieces(window: Column, open_: Callable[[Column], Column]) -> Column:
    """The stretches of open lines of a window, each joined to one candidate."""
    kind = "array<struct<paragraph:int,lines:int,text:string>>"
    state = F.struct(F.array().cast(kind).alias("done"), F.lit(False).alias("going"))

    def add(s: Column, x: Column) -> Column:
        last = F.element_at(s["done"], -1)
        longer = F.struct(
            last["paragraph"].alias("paragraph"), (last["lines"] + 1).alias("lines"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text")
        )
        fresh = F.struct(x["paragraph"].alias("paragraph"), F.lit(1).alias("lines"), x["text"].alias("text"))
        grown = F.when(
            s["going"], F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(longer))
        ).otherwise(F.concat(s["done"], F.array(fresh)))
        return F.when(
            open_(x), F.struct(grown.cast(kind).alias("done"), F.lit(True).alias("going"))
        ).otherwise(F.struct(s["done"].alias("done"), F.lit(False).alias("going")))

    return F.aggregate(window, state, add, lambda s: s["done"])


def _apart(found: Column) -> Column:
    """Of overlapping runs of one family the most alike, then the shortest, then the first."""
    ranked = F.array_sort(
        F.transform(found, lambda p: F.struct((-p["similarity"]).alias("s"), p["lines"].alias("l"), p["paragraph"].alias("n"), p.alias("p")))
    )
    meets = lambda a, b: (a["family"] == b["family"]) & (
        a["paragraph"] < b["paragraph"] + b["lines"]
    ) & (b["paragraph"] < a["paragraph"] + a["lines"])
    return F.aggregate(
        F.transform(ranked, lambda r: r["p"]), F.slice(found, 1, 0),
        lambda kept, p: F.when(F.exists(kept, lambda k: meets(k, p)), kept).otherwise(F.concat(kept, F.array(p)))
    )


def scan(docs: DataFrame, rules: LicenseRules = LicenseRules()) -> DataFrame:
    """One row per document: ``doc_id`` and ``paragraphs``, its confirmed licence notices.

    ``paragraphs`` is an array of ``struct<paragraph (from 0), lines, family, probability, similarity, text>``.
    A paragraph is a line, or a run of ``lines`` adjacent lines, from line ``paragraph`` on, of which none is
    a notice by itself: notices are often wrapped. Null, empty and plain texts have an empty array; repeated
    rows and null ids stay; an empty table gives an empty one.
    """
    model = train(rules)
    term = rf"(?i)\b(?:{_TERM_START})"
    text = F.col("text").cast("string")
    kind = "array<struct<paragraph:int,lines:int,text:string>>"
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("paragraph"), F.lit(1).alias("lines"), x.alias("text")))
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.when(text.rlike(term), numbered), F.array().cast(kind)).alias("every")
    )
    step = _confirmed(F.filter("every", lambda p: p["text"].rlike(term)), model, rules)(step).withColumnRenamed("p", "alone")
    runs = _runs(F.col("every"), F.transform("alone", lambda p: p["paragraph"]), term, rules.run_lines)
    step = _confirmed(F.when(F.size("every") > 1, runs).otherwise(F.array().cast(kind)), model, rules)(step)
    return step.select("doc_id", F.array_sort(F.concat("alone", _apart(F.col("p")))).alias("paragraphs"))


def summarise(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_notices, families, license_family, probability, similarity`` per document.

    ``license_family`` is that of the best confirmed notice (similarity, then probability, then the first),
    reserved rights last, as licence texts open with them; documents without one have the family ``unknown`` and nulls.
    """
    ranked = F.array_sort(
        F.transform(
            "paragraphs",
            lambda p: F.struct(
                (p["family"] == "proprietary").alias("r"), (-p["similarity"]).alias("s"), (-p["probability"]).alias("q"), p["paragraph"].alias("n"),
                p["family"].alias("f")
            )
        )
    )
    best = F.get(ranked, F.lit(0))
    return scanned.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_notices"), F.array_sort(
            F.array_distinct(F.transform("paragraphs", lambda p: p["family"]))
        ).alias("families"),
        F.coalesce(
            best["f"], F.lit(UNKNOWN_CLASS)
        ).alias("license_family"), F.round(-best["q"], 6).alias("probability"), F.round(-best["s"], 6).alias("similarity"),
    )
