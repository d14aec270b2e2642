"""Benchmark decontamination (operator 1): template windows with slot consistency, in DataFrame functions only.

A text is canonicalised by replacing numbers, units after a number, and names (capitalised words within a sentence)
with typed placeholders, dropping punctuation and lower-casing. Windows of ``window`` canonical words are hashed and
joined with the benchmark's. For each document and item whose shared windows reach ``least_share`` of the item's, the
words that stand at placeholders of shared windows are compared: a verbatim copy has the item's values, and a
re-parameterised copy has other values, but maps each value of the item to one value. A text that merely shares a
template with unrelated values is left alone. Each place that has ``least_share`` by itself is judged by itself, so
several variants of an item in one document do not hide each other; the document as a whole is judged too, for copies
that are torn apart.

Names are told by their capitals, so a copy whose case was changed has other placeholders. Each text therefore has a
second view, which is case-folded and keeps names as plain words. It counts where the first view does not reach
``least_share``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .rules import let

WINDOW = 5
LEAST_SHARE = 0.5
LEAST_CONSISTENCY = 0.8
#: Benchmark windows, or candidate pairs, up to which a side may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Typed placeholders: characters for private use. Texts lose them before anything else.
NUMBER, UNIT, NAME, NAME_END = "\ue001", "\ue002", "\ue003", "\ue004"
UNITS = "kilograms|grams|kilometers|kilometres|meters|metres|miles|hours|minutes|seconds|percent|dollars|euros|days|weeks|years|months|kg|mg|km|cm|mm|mph|ml|min|usd|eur|g|m|l|h|s|%|€|°C|°F"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] .)[\p{L}\p{M}]*"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_SPACES = r"\s+"
_MARKS = "[" + NUMBER + UNIT + NAME + "]"


def without_marks(text: Column) -> Column:
    return F.translate(text, NUMBER + UNIT + NAME + NAME_END, "")


def _without_punctuation(text: Column) -> Column:
    words = F.split(F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}\s{NUMBER}{UNIT}{NAME}{NAME_END}]+", ""), _SPACES)
    return F.filter(words, lambda w: w != "")


def folded(text: Column) -> Column:
    """The text without differences of case: ``ß`` and ``SS`` are equal too."""
    # the optimizer makes lower(upper(x)) into lower(x), which is another text where there is an ``ß``
    return F.lower(F.concat(F.upper(text), F.lit("")))


def marked_words(text: Column) -> Column:
    """The words of a text with placeholders for numbers and units, and marks around names.

    They stand at the same places as in :func:`plain_words`. Both views are made from them.
    """
    named = folded(F.regexp_replace(text, _NAME, f"{NAME}$0{NAME_END}"))
    counted = F.regexp_replace(named, _NUMBER, NUMBER)
    measured = F.when(F.contains(counted, F.lit(NUMBER)), F.regexp_replace(counted, rf"({NUMBER} ?{NAME}?)(?:{UNITS.lower()})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}"))
    return _without_punctuation(F.coalesce(measured, counted))


def canonical_words(words: Column) -> Column:
    """Marked words with a placeholder for each name."""
    return F.transform(words, lambda w: F.when(F.contains(w, F.lit(NAME)), F.concat(F.lit(NAME), F.substring_index(w, NAME_END, -1))).otherwise(w))


def folded_words(words: Column) -> Column:
    """Marked words with names as plain words."""
    return F.transform(words, lambda w: F.when(F.contains(w, F.lit(NAME)), F.translate(w, NAME + NAME_END, "")).otherwise(w))


def plain_words(text: Column) -> Column:
    """As :func:`folded_words` with the values at the placeholders: a number or unit keeps its letters and digits."""
    spaced = F.regexp_replace(folded(text), rf"([0-9] ?)(?:%|€)(?![\p{{L}}\p{{N}}])", f"$1{UNIT}")
    return _without_punctuation(spaced)


def _windows(words: Column, window: int) -> Column:
    def of(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))

    return let(words, of)


def _placed(df: DataFrame, key: str, window: int) -> DataFrame:
    """``key, row, view, i, h, w, v`` of each window of both views: 0 canonical, 1 folded.

    ``w`` and ``v`` are its words and plain words; the latter are empty where the two do not stand at the same places.
    """
    words = df.select(key, F.xxhash64("text").alias("row"), marked_words(F.col("text")).alias("m"), plain_words(F.col("text")).alias("v"))
    words = words.withColumn("v", F.when(F.size("m") == F.size("v"), F.col("v")).otherwise(F.array().cast("array<string>")))
    views = F.array(F.struct(F.lit(0).alias("view"), canonical_words(F.col("m")).alias("w")), F.struct(F.lit(1).alias("view"), folded_words(F.col("m")).alias("w")))
    words = words.select(key, "row", "v", F.explode(views).alias("x")).select(key, "row", "v", "x.*")
    # parts are cut out before the rows are made, so that no row carries all words of its text
    parts = F.transform(_windows(F.col("w"), window), lambda h, i: F.named_struct(F.lit("h"), h, F.lit("w"), F.slice("w", i + 1, window), F.lit("v"), F.slice("v", i + 1, window)))
    return words.select(key, "row", "view", F.posexplode(parts).alias("i", "x")).select(key, "row", "view", "i", "x.*")


def _values(window: int) -> Column:
    """The plain words at a window's placeholders, in order."""
    here = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.struct(F.get("w", k).rlike(_MARKS).alias("marked"), F.get("v", k).alias("v")))
    return F.transform(F.filter(here, lambda x: x["marked"]), lambda x: x["v"])


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item_id, view, j, h, counted, item_values, n_windows, all_slots``: each item's windows; those of two plain words count.

    ``all_slots`` is the number of different values that stand at the placeholders of all windows of the item.

    An item without such a window, one of placeholders only for instance, has no rows and is never found.
    """
    plain = F.size(F.filter("w", lambda x: ~x.rlike(_MARKS)))
    at = _placed(items, "item_id", window).select("item_id", "view", F.col("i").alias("j"), "h", (plain >= 2).alias("counted"), _values(window).alias("item_values"))
    slots = F.filter(F.array_distinct(F.flatten(F.collect_set("item_values"))), lambda v: v.isNotNull())
    n = at.groupBy("item_id", "view").agg(F.count_distinct(F.when(F.col("counted"), F.col("h"))).alias("n_windows"), F.size(slots).alias("all_slots")).where("n_windows > 0")
    return at.join(n, ["item_id", "view"])


def _bounded(df: DataFrame, name: str) -> DataFrame:
    """The table written once, marked for broadcast if it is small enough."""
    df = C.materialize(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE, least_consistency: float = LEAST_CONSISTENCY) -> DataFrame:
    """``doc_id, item_id, n_shared, n_windows, share, n_slots, slot_consistency, kind`` for each contaminated pair.

    ``kind`` is ``verbatim`` where every slot of the item is there and has the item's own value, or, case aside, all of its
    windows; otherwise ``reparameterised``. Where a
    text's words and values do not stand at the same places, no slot can be compared; such a pair is ``incomparable``
    and has no ``slot_consistency``. The placeholders' own characters are taken out of all texts first. Null or empty texts and items of fewer words than a window have no windows and match nothing. Repeated documents
    of one id count as one document, whose windows are those of all its rows; repeated items likewise. Further columns
    are ignored. Empty tables give an empty result. The figures of a pair are those of its best place, or of the whole
    document where that is better.
    """
    docs = C.id_and_text(docs).withColumn("text", without_marks(F.col("text")))
    items = C.id_and_text(items, "item_id").select(F.col("doc_id").alias("item_id"), without_marks(F.col("text")).alias("text"))
    of_items = C.materialize(_item_windows(items, window), "item-windows")
    bench = _bounded(of_items.where("counted").select("item_id", "view", "h", "n_windows").distinct(), "bench-windows")
    both = let(marked_words(F.col("text")), lambda m: F.array_distinct(F.concat(_windows(canonical_words(m), window), _windows(folded_words(m), window))))
    seen = docs.select("doc_id", F.explode(both).alias("h"))
    shared = (
        seen.join(bench, "h")
        .groupBy("doc_id", "item_id", "view", "n_windows", "h").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "item_id", "view", "n_windows").agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") / F.col("n_windows") >= least_share)
    )
    candidates = C.materialize(shared.select("doc_id", "item_id").distinct(), "candidates")
    return _check_slots(docs, of_items, candidates, window, least_share, least_consistency)


def _places(window: int) -> Column:
    """The groups of matches that a match belongs to.

    One is all of its document. The others are occurrences in one row: a copy's windows have the same distance
    between their places in the document and in the item, and up to ``window`` words more or less in a changed copy.
    """
    def group(row: Column, width: int, at: Column) -> Column:
        return F.struct(row.alias("row"), F.lit(width).alias("width"), at.cast("int").alias("at"))

    shift = F.col("i") - F.col("j")
    near = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda k: group(F.col("row"), window, shift - k))
    return F.concat(F.array(group(F.lit(0).cast("long"), -1, F.lit(0)), group(F.col("row"), 0, shift)), near)


def _check_slots(docs: DataFrame, of_items: DataFrame, candidates: DataFrame, window: int, least_share: float, least_consistency: float) -> DataFrame:
    few = candidates.count() <= BROADCAST_ROWS
    mark = F.broadcast if few else (lambda x: x)
    # a table of its own, so that windows are made of these documents only
    wanted = C.materialize(docs.join(mark(candidates.select(F.col("doc_id").alias("d")).distinct()), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"), "suspects")
    pairs = candidates.select(F.col("doc_id").alias("d"), "item_id")
    met = _placed(wanted, "doc_id", window).join(mark(pairs), F.col("doc_id").eqNullSafe(F.col("d"))).join(of_items, ["item_id", "view", "h"])
    values = F.zip_with("item_values", _values(window), lambda x, y: F.named_struct(F.lit("item_v"), x, F.lit("v"), y))
    met = met.select("doc_id", "item_id", "view", "n_windows", "all_slots", F.when(F.col("counted"), F.col("h")).alias("h"), F.explode(_places(window)).alias("place"), values.alias("values"))
    met = met.withColumn("value", F.explode_outer("values"))
    lost = F.col("value").isNotNull() & (F.col("value.item_v").isNull() | F.col("value.v").isNull())
    met = met.withColumn("lost", lost).withColumn("value", F.when(~lost, F.col("value")))
    of = [(F.col("view") == k) for k in (0, 1)]
    told = met.groupBy("doc_id", "item_id", "place").agg(
        *[F.size(F.collect_set(F.when(of[k], F.col("h")))).alias(f"n_{k}") for k in (0, 1)],
        *[F.max(F.when(of[k], F.col("n_windows"))).alias(f"of_{k}") for k in (0, 1)],
        *[F.max(F.when(of[k], F.col("all_slots"))).alias(f"all_{k}") for k in (0, 1)],
        *[F.collect_set(F.when(of[k], F.col("value"))).alias(f"values_{k}") for k in (0, 1)],
        *[F.max(F.when(of[k], F.col("lost"))).alias(f"lost_{k}") for k in (0, 1)],
    )
    reached = [F.coalesce(F.col(f"n_{k}") / F.col(f"of_{k}") >= least_share, F.lit(False)) for k in (0, 1)]
    # in the folded view names are words: it shows a whole copy where all its windows are there with the item's values
    items_1 = F.array_distinct(F.transform("values_1", lambda x: x["item_v"]))
    folded = reached[1] & ~F.coalesce("lost_1", F.lit(False)) & (F.col("n_1") == F.col("of_1")) & (F.size(items_1) >= F.col("all_1")) & F.forall(items_1, lambda i: F.exists("values_1", lambda x: (x["item_v"] == i) & (x["v"] == i)))
    told = told.where(reached[0] | reached[1]).select("doc_id", "item_id", reached[0].alias("canonical"), folded.alias("folded"), *[F.when(reached[0], F.col(f"{c}_0")).otherwise(F.col(f"{c}_1")).alias(c) for c in ("n", "of", "all", "values", "lost")])
    item_values = F.array_distinct(F.transform("values", lambda x: x["item_v"]))
    told = told.withColumn("slots", F.transform(item_values, lambda i: F.transform(F.filter("values", lambda x: x["item_v"] == i), lambda x: x["v"] == i)))
    told = told.withColumns({
        "n_slots": F.size("slots").cast("long"),
        "own": F.forall("slots", lambda s: F.exists(s, lambda x: x)),
        "single": F.size(F.filter("slots", lambda s: F.size(s) == 1)),
    })
    # a copy with all of the item's own values is verbatim, whatever else shares the template; one that lacks windows
    # with values of the item is not, though all that can be compared agree
    blank = F.col("lost") & (F.col("n_slots") == 0)
    whole = (F.col("canonical") & F.col("own") & ~blank & (F.col("n_slots") >= F.col("all"))) | F.col("folded")
    told = told.withColumns({"own": whole, "slot_consistency": F.when(blank & ~F.col("folded"), F.lit(None)).when(F.col("own") | F.col("folded"), 1.0).otherwise(F.col("single") / F.col("n_slots"))})
    told = told.where(F.col("slot_consistency").isNull() | (F.col("slot_consistency") >= least_consistency))
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("own", "slot_consistency", "n", "n_slots", "of")).alias("x"))
    return best.select(
        "doc_id", "item_id",
        F.col("x.n").cast("long").alias("n_shared"), F.col("x.of").alias("n_windows"), (F.col("x.n") / F.col("x.of")).alias("share"),
        "x.n_slots", "x.slot_consistency",
        F.when(F.col("x.own"), "verbatim").when(F.col("x.slot_consistency").isNull(), "incomparable").otherwise("reparameterised").alias("kind"),
    )
