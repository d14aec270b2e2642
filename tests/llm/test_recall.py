"""How many changed copies of benchmark items are found in documents, and how many clean documents are reported."""

import random
import re

import pytest

from driftline.llm import _common as C
from driftline.llm import decontam

SPELLED = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))


def with_values(text, rng):
    """The table's items have neither numbers nor names; here every ninth word is followed by one of either."""
    out = []
    for k, w in enumerate(text.split()):
        out.append(w)
        if k % 9 == 4:
            out.append(rng.choice(["Anna", "Boston", "Marek"]) if k % 2 else f"{rng.randint(2, 9)} {rng.choice(['km', 'boxes', 'kg', 'times'])}")
    return " ".join(out)


def changed(text, how, rng):
    if how == "literal":
        return text
    if how == "upper":
        return text.upper()
    if how == "lower":
        return text.lower()
    if how == "other values":
        return re.sub(r"[0-9]+", lambda m: str(int(m[0]) + rng.randint(1, 40)), text)
    if how == "other names":
        new = {}
        return re.sub(r"\b(?:Anna|Boston|Marek)\b", lambda m: new.setdefault(m[0], rng.choice(["Zelda", "Quentin", "Ophelia"]) + "abcdefgh"[len(new) % 8]), text)
    if how == "upper, other names":
        return changed(changed(text, "other names", rng), "upper", rng)
    return re.sub(r"\b[0-9]\b", lambda m: SPELLED[m[0]], text)  # spelled out


@pytest.mark.parametrize(
    ("how", "least", "verbatim"),
    [("literal", 0.9, True), ("upper", 0.9, True), ("lower", 0.9, True), ("other values", 0.9, False), ("other names", 0.9, False), ("spelled out", 0.9, False), ("upper, other names", 0.0, False)],
)
def test_recall_of_copies(spark, how, least, verbatim):
    rng = random.Random(17)
    items = [(r.item_id, with_values(r.text, rng)) for r in C.table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    clean = [r.text for r in C.table(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 4000").limit(60).collect()]
    docs = [(i, f"{rng.choice(clean)[:600]} {changed(text, how, rng)} {rng.choice(clean)[:600]}") for i, text in items]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hits = {(r.doc_id, r.item_id): r.kind for r in found.collect()}
    recall = sum((i, i) in hits for i, _ in items) / len(items)
    print(f"\nrecall of {how} copies: {recall:.3f} of {len(items)}, verbatim {sum(hits.get((i, i)) == 'verbatim' for i, _ in items) / len(items):.3f}")
    others = sum(d != i for d, i in hits)
    assert recall >= least and others == 0
    # changed values are not called verbatim; a name that begins a sentence is a word like others, not a value
    kinds = [hits[i, i] == "verbatim" for (i, text), (_, doc) in zip(items, docs, strict=True) if (i, i) in hits and text not in doc]
    assert verbatim or sum(kinds) <= 0.03 * len(items)
