"""Operator 7: language identification by family first, then pairs of linear SVMs.

A text's features are hashed counts of its letters' byte 1-, 2- and 3-grams, log
scaled and of unit length; every byte of the text counts.  One linear support
vector machine a family tells the family from the rest; within the winning family
every pair of languages has a machine of its own and the language with most votes
wins (sums of margins break ties).  All are trained here.

Training reads every labelled document that it is given: ``keep_identified`` gives all,
``language_report`` those with an id that aren't held out.  Rows are dealt by hash into blocks of about
``BLOCK``; a task fits the machines of a block, and a machine's weights are the mean
over the blocks, by the rows of the smaller of its two classes (parameter mixing).
Rows of a language with few of them go to several blocks, so that each has about
``_LEAST`` of every language or all there are.  Families of well-known codes are
stated below; a language not among them is a family of its own.  A caller may ask
for a bounded ``sample`` instead; nothing here does.

Null text, or text without a letter: ``und``, score 0.  So is everything if
nothing was learned.

``keep_identified`` rejects texts without a letter, and texts for which the
machines don't speak: neither the margin of the winning family nor the winner's
mean margin over its pairs reaches ``SLACK`` times what the weakest training row
of the text's size reaches, each in units of its median (to four digits).  The
fewer grams a text has, the less can be said of it, so a row sets the bound for
texts about as rich as itself: sizes are numbers of different grams by powers of
two.  A size with fewer than ``CLEAN_ROWS`` measured rows takes in the next smaller
ones until it has as many, and all rows if there are still fewer.  All training rows are
measured, by machines that didn't read them: half of them by those of the other
half; the weakest is taken of these and of what the machines that judge say of the
same rows, so that none of them is rejected.  With fewer than ``CLEAN_ROWS`` measured rows in all, one
language only, or a median that isn't above 0, there is
no such bound, and every text with a letter stays; so it does if nothing was learned.

A null ``lang`` is never learned from, nor a null ``doc_id`` by ``language_report`` or
in a ``sample``.  Repeated rows give repeated results, an empty table an empty result.  Input
columns are carried in one struct, so their names can't clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch

BLOCK = 4_000  # rows that are fitted together
_LEAST = 20  # rows of each language in a block, where there are as many
_REMEMBERED = 1 << 16  # rows a task remembers, to pass on each once
_FIXED = float(1 << 24)  # weights are summed as integers, in whatever order
WIDTH = 4096
_ROUNDS, _RATE, _DECAY = 150, 0.5, 1e-4
_NEAR = 0.1  # of the rows are near their margins, or as many as miss them
_ROUNDING = 1e-3  # of margins, at most
_PIECE = 1 << 20  # bytes counted at a time
_ALIKE = 64  # rows are judged together
UNKNOWN = "und"
SLACK = 0.5  # of the weakest training row's margins
CLEAN_ROWS = 50
_SIZES = WIDTH.bit_length() + 1

# Families of languages by code.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa sa ur",
    "semitic": "am ar he mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only:{lang}")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    counts = np.zeros(WIDTH, np.int64)
    raw = b" " + text.lower().encode() + b" "
    for at in range(0, len(raw), _PIECE):
        # A piece repeats the two bytes before it, so no gram is lost at a cut.
        before = min(at, 2)
        x = _FOLD[np.frombuffer(raw[at - before : at + _PIECE], np.uint8)].astype(np.uint32)
        two = x[:-1] << np.uint32(8) | x[1:]
        three = two[:-1] << np.uint32(8) | x[2:]
        counts[:256] += np.bincount(x[before:], minlength=256)
        for grams in (two[max(0, before - 1) :], three):
            counts[256:] += np.bincount((grams * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(WIDTH - 256), minlength=WIDTH - 256)
    counts[32] = 0
    scaled = np.log1p(counts).astype(np.float32)
    length = np.linalg.norm(scaled)
    return scaled / length if length else scaled


@dataclass
class Model:
    """Families, their languages, and the machines' weights (one row each, bias last)."""

    families: list[str]
    langs: list[list[str]]
    family_weights: np.ndarray
    pairs: list[dict[tuple[int, int], np.ndarray]]


_BIAS = np.float32(0.1)  # the feature that every text has


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What machines (one row each, bias last) say of each row; ``x`` is never copied."""
    return x @ weights[..., :-1].T + _BIAS * weights[..., -1]


def _margins_alike(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``_margins``, the same to the last digit whichever rows stand beside a row: each product is of as many rows."""
    rest = -len(x) % _ALIKE
    parts = [x[at : at + _ALIKE] for at in range(0, len(x), _ALIKE)]
    if rest:
        parts[-1] = np.pad(parts[-1], ((0, rest), (0, 0)))
    return np.concatenate([_margins(part, weights) for part in parts] or [_margins(x, weights)])[: len(x)]


def _machines(x: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """Linear support vector machines (squared hinge), by gradient steps with momentum; classes weigh the same.

    One row of weights for each of ``sides``, which hold 1 or -1 for a row's class and 0 for rows of
    neither.  All go through ``x`` together.

    A row beyond its margins adds nothing to a step, and a margin changes by no more than its weights
    move.  So the machines take the rows that are near their margins, and look at all others again when
    the weights have moved as far as those are beyond: the same steps as over all rows.
    """
    if not sides:
        return np.zeros((0, x.shape[1] + 1), np.float32)
    y = np.stack(sides, axis=1)
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0))).astype(np.float32)
    # A feature that no row has keeps weight 0.
    some = np.flatnonzero(x.any(axis=0))
    x, width = x[:, some], x.shape[1]
    longest = float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0) + _BIAS**2))
    w = np.zeros((len(sides), len(some) + 1), np.float32)
    step, seen, reach = np.zeros_like(w), w, 0.0
    for _ in range(_ROUNDS):
        if longest * float(np.linalg.norm(w - seen, axis=1).max()) + _ROUNDING >= reach:
            beyond = np.where(y != 0, y * _margins(x, w) - 1, np.inf).min(axis=1, initial=np.inf)
            reach = max(_ROUNDING, float(np.quantile(beyond, _NEAR, method="lower"))) if len(x) else np.inf
            near, seen = np.flatnonzero(beyond < reach), w.copy()
            rows, own, share = x[near], y[near], weight[near]
        miss = np.maximum(0, 1 - own * _margins(rows, w)) * own * share
        step = np.float32(0.9) * step - np.float32(_DECAY) * w
        step[:, :-1] += miss.T @ rows
        step[:, -1] += _BIAS * miss.sum(axis=0)
        w += np.float32(_RATE) * step
    found = np.zeros((len(sides), width + 1), np.float32)
    found[:, some], found[:, -1] = w[:, :-1], w[:, -1]
    return found


def fit(x: np.ndarray, langs: list[str], use: np.ndarray | None = None) -> Model | None:
    """A model of the languages named, or none without rows; ``use`` marks the rows to learn from."""
    names = np.array(langs, object)
    use = np.ones(len(names), bool) if use is None else use
    if not use.any():
        return None
    of = np.array([family_of(n) for n in langs])
    families = sorted(set(of[use]))
    side = lambda own, both: np.where(both, np.where(own, 1, -1), 0).astype(np.float32)
    heads = [side(of == f, use) for f in families] if len(families) > 1 else []
    members, named, sides = [], [], []
    for f, family in enumerate(families):
        own = sorted(set(names[use & (of == family)]))
        members.append([str(n) for n in own])
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                named.append((f, i, j))
                sides.append(side(names == own[i], use & ((names == own[i]) | (names == own[j]))))
    weights = _machines(x, heads + sides)
    pairs: list[dict[tuple[int, int], np.ndarray]] = [{} for _ in families]
    for (f, i, j), w in zip(named, weights[len(heads) :], strict=True):
        pairs[f][i, j] = w
    head_weights = weights[: len(heads)] if heads else np.zeros((len(families), x.shape[1] + 1), np.float32)
    return Model([str(f) for f in families], members, head_weights, pairs)


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))


def _judge(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and the two margins (family, mean of the pairs; NaN if there are none) of each row of features."""
    found = np.full((len(x), 2), np.nan)
    margins = _margins_alike(x, model.family_weights)
    family = margins.argmax(axis=1)
    score = np.ones(len(x))
    if len(model.families) > 1:
        found[:, 0] = margins[np.arange(len(x)), family]
        score = _squash(found[:, 0])
    out = np.empty(len(x), object)
    for f in range(len(model.families)):
        rows = np.flatnonzero(family == f)
        langs = model.langs[f]
        if not len(rows):
            continue
        votes, sums, lead = (np.zeros((len(rows), len(langs))) for _ in range(3))
        for (i, j), w in model.pairs[f].items():
            margin = _margins_alike(x, w[None])[rows, 0]
            won = _squash(margin)
            votes[:, i] += margin > 0
            votes[:, j] += margin <= 0
            sums[:, i] += won
            sums[:, j] += 1 - won
            lead[:, i] += margin
            lead[:, j] -= margin
        best = (votes + 1e-3 * sums).argmax(axis=1)
        out[rows] = np.array(langs, object)[best]
        if len(langs) > 1:
            score[rows] *= sums[np.arange(len(rows)), best] / (len(langs) - 1)
            found[rows, 1] = lead[np.arange(len(rows)), best] / (len(langs) - 1)
    return out.tolist(), score, found


def predict(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of features."""
    return _judge(model, x)[:2]


def margin_bound(x: np.ndarray, langs: list[str]) -> np.ndarray | None:
    """Family and pair margin below both of which a text is of no language that was learned."""
    names, half = np.array(langs), np.arange(len(langs)) % 2 == 0
    measured = []
    for told in (half, ~half):
        model = fit(x, langs, ~told)
        if model is not None:
            measured.append(_judge(model, x)[2][told & np.isin(names, names[~told])])
    found = np.concatenate(measured) if measured else np.empty((0, 2))
    found = found[~np.isnan(found).all(axis=1)]
    if len(found) < CLEAN_ROWS:
        return None
    usual = np.array([np.median(m[~np.isnan(m)]) if (~np.isnan(m)).any() else np.inf for m in found.T])
    if (usual <= 0).any():
        return None
    return _slack(np.nanmax(found / usual, axis=1).min(), usual)


def _slack(least: float | np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The bound (one column a size, if there are several), from the weakest rows' margins in units of the usual ones."""
    return np.multiply.outer(np.where(np.isinf(usual), 0, usual), least - (1 - SLACK) * np.abs(least))


def _sizes(x: np.ndarray) -> np.ndarray:
    """How many bits the number of a row's features has."""
    return np.frexp(np.count_nonzero(x, axis=1))[1]


def _least_by_size(found: dict[int, tuple[int, float]]) -> np.ndarray:
    """The weakest row for texts of each size, from the number of measured rows and the weakest of those sizes that there are."""
    out = np.full(_SIZES, min(least for _, least in found.values()))
    for size in range(_SIZES):
        rows, least = 0, np.inf
        for smaller in range(size, -1, -1):
            n, weakest = found.get(smaller, (0, np.inf))
            rows, least = rows + n, min(least, weakest)
            if rows >= CLEAN_ROWS:
                out[size] = least
                break
    return out


def speaks(margins: np.ndarray, bound: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Whether one of the two margins, of those a text has, reaches its bound; ``sizes`` pick the columns of a bound by size."""
    if bound.ndim > 1:
        bound = bound[:, sizes].T
    return (margins >= bound).any(axis=1) | np.isnan(margins).all(axis=1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        keep = [i for i, t in enumerate(texts) if has_letter(t)]
        rows = [features(texts[i]).astype(np.float16).tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary())], ["lang", "features"]
        )


def _sample_of(labelled: DataFrame, sample: int) -> DataFrame | None:
    """``lang, features`` of ``labelled`` rows (``doc_id, text, lang``), of ``sample`` at most; none without any."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # One row a language.
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # A cut of the hash leaves little more than a language's share, whatever its size; the window is over that.
    wanted = labelled.sparkSession.createDataFrame(
        [(lang, min(1.0, (1.5 * each + 50) / n)) for lang, n in counts.items()], "_lang string, share double"
    )
    row = ["doc_id", "lang", "text_key"]
    keyed = usable.withColumn("text_key", F.xxhash64("text"))
    place = F.xxhash64("doc_id", "text_key", F.lit(7))
    near = (place / float(2**64) + 0.5) <= F.col("share")
    few = keyed.select(*row).join(F.broadcast(wanted), F.col("lang") == F.col("_lang")).filter(near).select(*row).distinct()
    first = Window.partitionBy("lang").orderBy(place, "doc_id", "text_key")
    # At most ``sample`` keys of a few bytes.
    chosen = F.broadcast(few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= each).select(*row))
    # Rows that repeat an id and a text are one; each task passes on one of them.
    once = keyed.join(chosen, row, "left_semi").groupBy(*row).agg(F.first("text").alias("text"))
    return once.select("lang", "text").mapInArrow(_feature_rows, "lang string, features binary")


def _packed(row: np.ndarray) -> bytes:
    """A row of features: which aren't zero, a bit each, then those."""
    some = row != 0
    return np.packbits(some).tobytes() + row[some].astype(np.float16).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    row = np.zeros(WIDTH, np.float16)
    row[np.unpackbits(np.frombuffer(raw, np.uint8, WIDTH // 8)).astype(bool)] = np.frombuffer(raw, np.float16, offset=WIDTH // 8)
    return row


_DEALT = "lang string, features binary, place long, copies int"
_FITTED = "part int, kind string, a string, b string, rows long, weights array<float>"


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed features of texts with a letter; of rows that repeat an id and a text, one a task as far as it remembers."""
    known = set()
    for batch in batches:
        langs, texts, places = (batch.column(i).to_pylist() for i in range(3))
        keep = []
        for i, text in enumerate(texts):
            if (langs[i], places[i]) not in known and has_letter(text):
                if len(known) >= _REMEMBERED:
                    known.clear()
                known.add((langs[i], places[i]))
                keep.append(i)
        at = pa.array(keep, pa.int64())
        rows = pa.array([_packed(features(texts[i])) for i in keep], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), rows, batch.column(2).take(at), batch.column(3).take(at)],
            ["lang", "features", "place", "copies"],
        )


def _dealt(labelled: DataFrame) -> DataFrame | None:
    """Features of all ``labelled`` rows (``doc_id, text, lang``) by ``block``; none without any.

    ``place`` is the same for rows that repeat an id (or null) and a text; ``first`` marks one of a row's blocks.
    """
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    # One row a language.
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    blocks = -(-sum(counts.values()) // BLOCK)
    copies = labelled.sparkSession.createDataFrame(
        [(lang, min(blocks, -(-_LEAST * blocks // n))) for lang, n in counts.items()], "_lang string, copies int"
    )
    rows = usable.select("lang", "text", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)).alias("place"))
    rows = rows.join(F.broadcast(copies), F.col("lang") == F.col("_lang")).select("lang", "text", "place", "copies")
    found = rows.mapInArrow(_packed_rows, _DEALT)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    block = F.pmod(F.pmod("place", F.lit(blocks)) + F.col("copy"), F.lit(blocks))
    return found.select(block.alias("block"), "lang", "place", (F.col("copy") == 0).alias("first"), "features")


def _block(table: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Features, languages, halves (by hash) and first marks of a block's rows, each once and in one order."""
    langs, places, first, rows = (table.column(c).to_pylist() for c in ("lang", "place", "first", "features"))
    once = {(lang, place): i for i, (lang, place) in enumerate(zip(langs, places, strict=True))}
    order = sorted(once)
    x = np.empty((len(order), WIDTH), np.float32)
    for i, row in enumerate(order):
        x[i] = _unpacked(rows[once[row]])
    half = np.array([place >> 40 & 1 == 1 for _, place in order], bool)
    return x, [lang for lang, _ in order], half, np.array([first[once[row]] for row in order], bool)


def _named_machines(part: int, model: Model, langs: list[str]) -> Iterator[tuple]:
    """Rows of ``_FITTED``: the languages of a model, and its machines, by the rows of the smaller class."""
    many = {lang: langs.count(lang) for lang in set(langs)}
    for f, family in enumerate(model.families):
        own = model.langs[f]
        yield from ((part, "lang", lang, "", many[lang], []) for lang in own)
        rows = sum(many[lang] for lang in own)
        if len(model.families) > 1:
            yield part, "family", family, "", min(rows, len(langs) - rows), model.family_weights[f].tolist()
        for (i, j), w in model.pairs[f].items():
            yield part, "pair", own[i], own[j], min(many[own[i]], many[own[j]]), w.tolist()


def _fitter(parts: int):
    """The machines of a block: of all its rows, and of each half if there are three parts."""
    kinds = pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float32())
    names = ["part", "kind", "a", "b", "rows", "weights"]

    def fitted(table: pa.Table) -> pa.Table:
        x, langs, half, _ = _block(table)
        found = []
        for part, use in enumerate((np.ones(len(langs), bool), half, ~half)[:parts]):
            model = fit(x, langs, use)
            if model is not None:
                found += _named_machines(part, model, [lang for lang, u in zip(langs, use, strict=True) if u])
        columns = zip(*found, strict=True) if found else [()] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return fitted


def _mean_model(rows: list[Row]) -> Model | None:
    """A model of the mean machines of one part; where no block had both classes there is none."""
    langs = sorted(r["a"] for r in rows if r["kind"] == "lang")
    if not langs:
        return None
    weights = {(r["kind"], r["a"], r["b"]): np.array([w["w"] for w in r["weights"]], np.float32) for r in rows if r["kind"] != "lang"}
    families = sorted({family_of(lang) for lang in langs})
    members = [[lang for lang in langs if family_of(lang) == f] for f in families]
    nothing = np.zeros(WIDTH + 1, np.float32)
    heads = np.stack([weights.get(("family", f, ""), nothing) for f in families])
    pairs = [
        {(i, j): weights["pair", own[i], own[j]] for i in range(len(own)) for j in range(len(own)) if ("pair", own[i], own[j]) in weights}
        for own in members
    ]
    return Model(families, members, heads, pairs)


def _mean_models(dealt: DataFrame, parts: int) -> list[Model | None]:
    """The machines of all blocks, averaged: one model a part."""
    each = dealt.groupBy("block").applyInArrow(_fitter(parts), _FITTED)
    machine = ["part", "kind", "a", "b"]
    places = each.select(*machine, "rows", F.posexplode_outer("weights").alias("at", "w"))
    share = F.round(F.col("w").cast("double") * F.col("rows") * _FIXED).cast("long")
    means = places.groupBy(*machine, "at").agg((F.sum(share) / F.sum("rows") / _FIXED).alias("w"))
    # As many rows as there are machines and languages.
    rows = means.groupBy(*machine).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("weights")).collect()
    return [_mean_model([r for r in rows if r["part"] == part]) for part in range(parts)]


def _measured_bound(dealt: DataFrame, models: list[Model | None], scratch: Scratch) -> np.ndarray | None:
    """The bound of ``margin_bound`` for each size, from every row as the machines of the other half see it.

    The weakest row is that to the machines that judge (the first of ``models``), too, so no row that
    was learned from is below the bound.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(models)

    def measure(table: pa.Table) -> pa.Table:
        x, langs, half, first = _block(table)
        found = [np.empty((0, 4))]
        # The model of a half read the rows that are marked.
        for apart, model, told in zip((0, 1, 1), shared.value, (np.ones(len(langs), bool), ~half, half), strict=True):
            if model is not None:
                learned = {lang for own in model.langs for lang in own}
                rows = np.flatnonzero(told & first & np.array([lang in learned for lang in langs], bool))
                for at in range(0, len(rows), 256):
                    some = x[rows[at : at + 256]]
                    found.append(np.column_stack([_judge(model, some)[2], np.full(len(some), apart), _sizes(some)]))
        columns = np.concatenate(found).T
        return pa.Table.from_arrays([pa.array(c, mask=np.isnan(c)) for c in columns], ["family", "pair", "apart", "size"])

    seen = dealt.groupBy("block").applyInArrow(measure, "family double, pair double, apart double, size double")
    seen = scratch.keep(seen.filter("family IS NOT NULL OR pair IS NOT NULL"), "margins")
    kinds = "family", "pair"
    row = seen.filter("apart = 1").agg(F.count("*").alias("n"), *(F.percentile(F.round(k, 4), 0.5).alias(k) for k in kinds)).first()
    usual = np.array([np.inf if row[k] is None else row[k] for k in kinds])
    bound = None
    if row["n"] >= CLEAN_ROWS and (usual > 0).all():
        units = [F.col(k) / F.lit(float(u)) for k, u in zip(kinds, usual, strict=True)]
        # As many rows as there are sizes.
        rows = seen.groupBy("size").agg(F.count_if(F.col("apart") == 1).alias("n"), F.min(F.greatest(*units)).alias("least")).collect()
        bound = _slack(_least_by_size({int(r["size"]): (r["n"], r["least"]) for r in rows}), usual)
    scratch.drop(seen)
    return bound


def _learned_from_all(labelled: DataFrame, bounded: bool) -> tuple[Model | None, np.ndarray | None]:
    """A model of every labelled row and, if asked for, the bound that they set."""
    dealt = _dealt(labelled)
    if dealt is None:
        return None, None
    if not bounded:
        return _mean_models(dealt, 1)[0], None
    scratch = Scratch(labelled.sparkSession, "language-id")
    dealt = scratch.keep(dealt, "features")
    model, *halves = _mean_models(dealt, 3)
    bound = None if model is None else _measured_bound(dealt, [model, *halves], scratch)
    scratch.drop(dealt)
    return model, bound


def _learned(rows: DataFrame | None, bounded: bool) -> tuple[Model | None, np.ndarray | None]:
    """A model of a sample's rows and, if asked for, their bound.

    One task fits them, since they are ``sample`` rows at most; only weights come back.
    """
    if rows is None:
        return None, None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(pair for batch in batches for pair in zip(*batch.to_pydict().values(), strict=True))
        langs = [lang for lang, _ in found]
        x = np.empty((len(found), WIDTH), np.float32)
        for i in range(len(found)):
            x[i] = np.frombuffer(found[i][1], np.float16)
            found[i] = None
        bound = margin_bound(x, langs) if bounded and langs else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((fit(x, langs), bound))], pa.binary())], ["learned"])

    (row,) = rows.repartition(1).mapInArrow(learn, "learned binary").collect()
    return pickle.loads(row["learned"])


def _taught(labelled: DataFrame, sample: int | None, bounded: bool) -> tuple[Model | None, np.ndarray | None]:
    return _learned_from_all(labelled, bounded) if sample is None else _learned(_sample_of(labelled, sample), bounded)


def train(labelled: DataFrame, sample: int | None = None) -> Model | None:
    """A model of ``labelled`` rows (``doc_id, text, lang``): of all, or of ``sample`` at most."""
    return _taught(labelled, sample, bounded=False)[0]


def held_out(doc_id: Column) -> Column:
    """A third of the documents, which training never reads."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model | None, bound: np.ndarray | None = None) -> DataFrame:
    """``doc`` (a struct of all columns), ``lang_pred``, ``score`` and ``spoken`` for every row.

    ``spoken`` is false for texts without a letter and, with a ``bound``, for those below it, which are
    of no language that was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, bound))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            spoken = np.array([has_letter(t) for t in texts], bool)
            rows = np.flatnonzero(spoken) if known else []
            if len(rows):
                x = np.stack([features(texts[i]) for i in rows])
                found, score, margins = _judge(known, x)
                if least is not None:
                    spoken[rows] = speaks(margins, least, _sizes(x))
                told = spoken[rows]
                names[rows[told]] = np.array(found, object)[told]
                scores[rows[told]] = score[told]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spoken, pa.bool_())],
                ["doc", "lang_pred", "score", "spoken"],
            )

    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs["text"].alias("text"))
    schema = f"doc {packed.schema['doc'].dataType.simpleString()}, lang_pred string, score double, spoken boolean"
    return packed.mapInArrow(tell, schema)


def language_report(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; learns from rows with an id that aren't held out."""
    read = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = identify(docs.select("doc_id", "text"), train(read.select("doc_id", "text", "lang"), sample))
    return told.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """``docs`` without the rows of no language: no text, none with a letter, or margins below the bound.

    Nothing is measured on held-out rows here, so every labelled row is learned from.
    """
    model, bound = _taught(docs.select("doc_id", "text", "lang"), sample, bounded=True)
    return identify(docs, model, bound).filter("spoken").select("doc.*")
