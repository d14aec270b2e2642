"""Quality rules, quality classifier, decontamination, language model and personal data on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from driftline.llm import ctw, decontam, pii, quality_bayes, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_against_brute_force(docs, no_docs, rows, spark):
    rng = random.Random(1)
    more = [(100 + k, "".join(rng.choice(["the ", "fox ", "run\n", "a\t", "#", "x! ", "\n", "é "]) for _ in range(rng.randint(0, 200))), "en", "s") for k in range(60)]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = sorted(map(tuple, rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for i, text, *_ in [*rows, *more]:
        text = text or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want, key=str)
    assert rules.quality_rules(no_docs).count() == 0


def test_rules_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, base_failed, kept, n_repeat_words FROM ({rules.oracle()})").fetchall()))
    got = rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "base_failed", "kept", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == want


def test_rules_plan_is_native(docs):
    plan = rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.quality_ for r in quality_bayes.classify(docs, train).collect()}
    assert len(got) == docs.count()
    right = [got[i].kept == (q == 1) for i, q in test.items()]
    assert sum(right) / len(right) > 0.95
    good = [got[i].kept for i, q in test.items() if q == 1]
    assert sum(good) / len(good) > 0.97


def test_quality_edge_cases(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_bayes.classify(docs, labels)
    assert out.columns == [*docs.columns, "quality_"] and out.count() == docs.count()
    assert all(0 <= r.quality_.posterior <= 1 for r in out.collect())
    one = quality_bayes.classify(docs, labels.where("quality = 1"))
    assert all(r.quality_.kept for r in one.collect())
    assert all(r.quality_.kept for r in quality_bayes.classify(docs, labels.where("false")).collect())
    assert quality_bayes.classify(no_docs, labels).count() == 0
    hosts = {r.quality_.host: r.quality_.path for r in out.collect()}
    assert hosts["host.example"] == "path"


def test_quality_with_clashing_names(spark):
    rows = [(k, "good plain words about things " * (1 + k % 3) if k % 2 else "x# $$ 12 !!" * 9, f"http://h{k % 3}.example/p{k % 2}", k, "a", "b", 7, 8) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, dl_h int, host string, evidence string, quality_ int, n int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    out = quality_bayes.classify(docs, labels, column="verdict")
    assert out.columns == [*docs.columns, "verdict"]
    assert sorted(tuple(r)[:8] for r in out.collect()) == rows
    assert sorted(quality_bayes.classify(docs, labels).columns) == sorted(docs.columns)


def test_quality_against_brute_force(spark):
    """Sums by site, both strengths and every posterior from their formulas in plain Python."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        site = rng.choice(["a"] * 6 + ["b", "b", "c", "d", "e"])
        good = rng.random() < {"a": 0.9, "b": 0.2}.get(site, 0.5)
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) if good or rng.random() < 0.3 else rng.choice(["#", "!!", "99"]) for _ in range(rng.randint(3, 40))]
        rows.append((k, " ".join(words), "en", f"http://{site}.example/{rng.choice('xyz')}/{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(len(set(rows[k][1].split()) & {"#", "!!", "99"}) == 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_ for r in quality_bayes.classify(docs, labels).collect()}
    base = labels.agg({"quality": "avg"}).first()[0]
    prior = math.log(base / (1 - base))
    p = {k: 1 / (1 + math.exp(-(got[k].evidence + prior))) for k in got}
    place = {k: (r[3].split("/")[2], r[3].split("/")[3]) for k, r in enumerate(rows)}
    n, good = Counter(), Counter()
    for k, (h, x) in place.items():
        for key in ((h, x), (h,), ()):
            n[key] += 1
            good[key] += p[k]
    rate = good[()] / n[()]

    def strength(keys, centre):
        spread = sum(n[s] * (good[s] / n[s] - centre(s)) ** 2 for s in keys)
        noise = sum(centre(s) * (1 - centre(s)) for s in keys)
        base_ = sum(n[s] * centre(s) * (1 - centre(s)) for s in keys)
        between = max((spread - noise) / sum(n[s] for s in keys), 0)
        return min(max(base_ / sum(n[s] for s in keys) / between - 1, quality_bayes.LEAST_STRENGTH), quality_bayes.MOST_STRENGTH) if between else quality_bayes.MOST_STRENGTH

    k_host = strength([s for s in n if len(s) == 1], lambda s: rate)
    k_path = strength([s for s in n if len(s) == 2], lambda s: (good[s[:1]] + k_host * rate) / (n[s[:1]] + k_host))
    for k, (h, x) in place.items():
        host_rate = (good[h,] - p[k] + k_host * rate) / (n[h,] - 1 + k_host)
        path_rate = (good[h, x] - p[k] + k_path * host_rate) / (n[h, x] - 1 + k_path)
        posterior = 1 / (1 + math.exp(-(got[k].evidence + math.log(path_rate / (1 - path_rate)))))
        assert abs(got[k].site_rate - path_rate) < 1e-9 and abs(got[k].posterior - posterior) < 1e-9
        assert got[k].kept == (posterior >= quality_bayes.KEEP_AT)
    assert len({x.kept for x in got.values()}) == 2


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "en", 0.2)] * 200 + [("other", "en", 0.9)] * 200 + [("third", "en", 0.6)] * 50 + [("tiny", "en", 0.0)]
    table, rate, k_host, k_path = quality_bayes.sites(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.host: (r.host_good + k_host * rate) / (r.host_n + k_host) for r in table.collect()}
    assert abs(got["big"] - 0.2) < 0.05 and abs(got["other"] - 0.9) < 0.05 and got["tiny"] > 0.3


ITEM = "If a train leaves Boston at 5 km per hour and meets Anna after 12 hours then how far did the old train of Anna go before night came over the wide valley?"


def test_decontamination(spark, docs, no_docs):
    items = spark.createDataFrame([(0, ITEM), (1, None), (2, "too short"), (3, "")], "item_id long, text string")
    other = ITEM.replace("Boston", "Lyon").replace("Anna", "Marie").replace("5 km", "8 km").replace("12", "31")
    mixed = ITEM.replace("Anna", "Marie", 1).replace("Boston", "Lyon")
    rows = [(50, f"Before it. {ITEM} After it."), (51, f"Some words. {other} More words."), (52, "nothing of the kind " * 20), (53, ITEM.upper()[:40]), (54, f"x {mixed} y")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in decontam.contaminated(df, items).collect()}
    assert {50, 51} <= set(got) <= {50, 51, 54}
    assert got[50].kind == "verbatim" and got[51].kind == "reparameterised" and got[51].slot_consistency == 1.0
    assert 54 not in got or got[54].slot_consistency < 1.0
    assert decontam.contaminated(no_docs, items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).count() == 0


def test_decontamination_of_changed_case(spark):
    german = "Anna und Otto gehen um 5 Uhr auf der langen Straße von Bonn nach Köln und zählen dort 12 große Schiffe am Ufer."
    items = spark.createDataFrame([(0, ITEM), (1, german)], "item_id long, text string")
    rows = [(1, f"Before it. {ITEM.upper()} After it."), (2, f"x {ITEM.lower()} y"), (3, f"x {ITEM.title()} y"), (4, f"SO. {german.upper()} DA."), (5, "THE OLD TRAIN AND THE WIDE VALLEY " * 9)]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 1)} and all(r.kind == "verbatim" for r in got.values())


def test_all_items_are_found_in_capitals(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = items.selectExpr("item_id AS doc_id", "concat('Some words before. ', upper(text), ' and after.') AS text")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    want = {(r.item_id, r.item_id) for r in items.collect() if len((r.text or "").split()) >= decontam.WINDOW + 2}
    assert want and want <= found


def test_variants_in_one_document(spark):
    twice = "Anna has 3 red apples in the old basket and Otto has 4 red apples in the old basket so how many red apples are in the old basket of both?"
    again = "then Anna gave Otto 3 pears and so Otto gave Anna 3 plums while we saw Anna and then Otto eat the rest of them at home"
    items = spark.createDataFrame([(0, ITEM), (1, twice), (2, again)], "item_id long, text string")

    def variant(city, name, km, hours):
        return ITEM.replace("Boston", city).replace("Anna", name).replace("5 km", f"{km} km").replace("12", str(hours))

    first, second = variant("Lyon", "Marie", 8, 31), variant("Paris", "Otto", 9, 44)
    names = iter("Ida Jan Kai Lea Max Nina Olga Paul Rosa Sven Tim Uwe".split())
    mixed = [re.sub("Anna|Otto", lambda m: next(names), again) for _ in range(2)]  # no place maps a name to one name
    rows = [
        (1, f"1. {first} 2. {second} End."),
        (2, f"x {first} y " + "nothing of the kind " * 50 + second[:80]),
        (3, "z " + twice.replace("Anna", "Marie").replace("Otto", "Paul").replace("3", "7").replace("4", "9")),
        (4, f"x {mixed[0]} y {mixed[1]} z"),
        (5, first), (5, second),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 1), (5, 0)} and all(r.kind == "reparameterised" and r.slot_consistency == 1.0 for r in got.values())


MARKS = decontam.NUMBER + decontam.UNIT + decontam.NAME
LETTERS = r"[^\p{L}\p{M}\p{N} \t\n\r\f\x0b" + MARKS + decontam.NAME_END + "]+"


def brute_words(text):
    """Canonical, folded and plain words of a text."""
    fold = lambda s: s.upper().lower()
    cut = lambda s: [w for w in regex.split(r"[ \t\n\r\f\x0b]+", regex.sub(LETTERS, "", s)) if w]
    text = "".join(c for c in text if c not in MARKS + decontam.NAME_END)
    named = fold(regex.sub(r"\p{Lu}(?<=[\p{L}\p{N},;] .)[\p{L}\p{M}]*", lambda m: decontam.NAME + m[0] + decontam.NAME_END, text))
    named = regex.sub(r"[0-9]+([.,][0-9]+)*", decontam.NUMBER, named)
    named = regex.sub(rf"({decontam.NUMBER} ?{decontam.NAME}?)({decontam.UNITS.lower()})(?![\p{{L}}\p{{N}}])", lambda m: m[1] + decontam.UNIT, named)
    marked = cut(named)
    canonical = [decontam.NAME + w.rsplit(decontam.NAME_END, 1)[-1] if decontam.NAME in w else w for w in marked]
    folded = [w.replace(decontam.NAME, "").replace(decontam.NAME_END, "") for w in marked]
    plain = cut(regex.sub(r"([0-9] ?)[%€](?![\p{L}\p{N}])", lambda m: m[1] + decontam.UNIT, fold(text)))
    return canonical, folded, plain


def brute_windows(text, k=decontam.WINDOW):
    canonical, folded, plain = brute_words(text)
    assert len(canonical) == len(plain)
    out = []
    for words in (canonical, folded):
        marked = [any(c in MARKS for c in w) for w in words]
        out.append([(tuple(words[i : i + k]), sum(not m for m in marked[i : i + k]) >= 2, [plain[j] for j in range(i, i + k) if marked[j]]) for i in range(len(words) - k + 1)])
    return out


def brute_pairs(docs, items, k=decontam.WINDOW):
    out = {}
    for d, text in docs.items():
        for i, item in items.items():
            of, own_windows, matches = {}, brute_windows(item), []
            here = brute_windows(text)
            for view in (0, 1):
                counted = {w for w, c, _ in own_windows[view] if c}
                of[view] = len(counted)
                matches += [(view, p, j, w, c, list(zip(iv, v))) for p, (w, _, v) in enumerate(here[view]) for j, (x, c, iv) in enumerate(own_windows[view]) if x == w and of[view]]
            share = lambda found, view: of[view] and len({w for v, _, _, w, c, _ in found if v == view and c}) / of[view]
            if max(share(matches, 0), share(matches, 1)) < decontam.LEAST_SHARE:
                continue
            places = {}
            for m in matches:
                for place in ["all", (0, m[1] - m[2]), *[(k, m[1] - m[2] - x) for x in range(k + 1)]]:
                    places.setdefault(place, []).append(m)
            best = None
            for found in places.values():
                told = {}
                for view in (0, 1):
                    pairs = {x for v, *_, values in found if v == view for x in values}
                    slots = {a: [b == a for x, b in pairs if x == a] for a, _ in pairs}
                    agree, n = all(map(any, slots.values())), len({w for v, _, _, w, c, _ in found if v == view and c})
                    every = agree and len(slots) >= len({x for _, _, values in own_windows[view] for x in values})
                    told[view] = slots, agree, n, every and (view == 0 or n == of[view])
                view = next((v for v in (0, 1) if share(found, v) >= decontam.LEAST_SHARE), None)
                if view is None:
                    continue
                slots, agree, n, whole = told[view]
                folded = share(found, 1) >= decontam.LEAST_SHARE and told[1][3]
                consistency = 1.0 if agree or folded else sum(len(s) == 1 for s in slots.values()) / len(slots)
                if consistency >= decontam.LEAST_CONSISTENCY:
                    best = max(best or (False,), (whole or folded, consistency, n, len(slots), of[view]))
            if best:
                out[d, i] = (best[2], best[4], best[3], round(best[1], 9), "verbatim" if best[0] else "reparameterised")
    return out


def test_a_copy_with_some_values_spelled_out_is_not_verbatim(spark):
    """All slots that can still be compared agree, but windows of the item are missing."""
    item = "the old mill by the river sells 40 sacks of flour each day and the boat carries them 12 times a week to the town while 5 km of road stay empty"
    changed = item.replace("12 times", "twelve times").replace("5 km", "five km")
    docs = spark.createDataFrame([(1, f"before it all {item} and after"), (2, f"before it all {changed} and after")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1].kind == "verbatim" and got[2].kind == "reparameterised" and got[2].slot_consistency == 1.0 and got[2].n_slots < got[1].n_slots


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    names, units = "Anna Otto Boston Lyon Marie Paul Zürich Élodie".split(), ["km", "kg", "%", "hours", "m", "", " €", " dollars"]
    plain = "the of and a then so how many far old red basket valley train goes before after who what le große straße".split()

    def sentence():
        return " ".join(rng.choice([rng.choice(plain)] * 5 + [rng.choice(names), f"{rng.randint(1, 99)}{rng.choice(units)}", f"{rng.randint(1, 9)},{rng.randint(0, 9)} {rng.choice(units)}"]) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(4, 26)))

    items = {i: sentence() for i in range(25)}

    def changed(text):
        how = rng.randint(0, 5)
        if how == 1:
            return text.upper()
        if how == 2:
            new = dict(zip(names, rng.sample(names, len(names))))
            return regex.sub("|".join(names), lambda m: new[m[0]], text)
        if how == 3:
            return regex.sub("[0-9]+", lambda m: str(rng.randint(1, 99)), text)
        if how == 4:
            return text.replace(rng.choice(plain), rng.choice(plain))
        return text

    docs = {d: " ".join(x for _ in range(rng.randint(1, 3)) for x in (sentence(), changed(items[rng.randrange(25)]), "\ue001 \ue003" if rng.random() < 0.2 else "")) for d in range(70)}
    got = decontam.contaminated(spark.createDataFrame([*docs.items()], "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_windows, r.n_slots, round(r.slot_consistency, 9), r.kind) for r in got.collect()}
    want = brute_pairs(docs, items)
    assert len(want) > 40 and len({x[-1] for x in want.values()}) == 2
    assert got == want


def test_placeholder_characters_in_texts(spark):
    items = spark.createDataFrame([(0, ITEM), (1, "3 4 5 6 7 8 9 10")], "item_id long, text string")
    marks = ITEM.replace("5 km", "\ue001 \ue002").replace("Boston", "\ue003").replace("Anna", "\ue003").replace("12", "\ue001")
    rows = [(1, "some words then \ue001 \ue002 \ue003 and more of the same words " * 3), (2, marks), (3, ITEM[:40] + "\ue001" + ITEM[40:]), (4, "3 4 5 6 7 8 9 10")]
    got = {r.doc_id: r.kind for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got.get(3) == "verbatim" and 1 not in got and 4 not in got


def test_decontamination_plan_is_native(spark, docs):
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    plan = decontam.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_planted_items_are_found(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, bench = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    want = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}
    assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class BruteTree:
    """Context-tree weighting by direct recursion over contexts."""

    def __init__(self, texts, depth):
        self.counts, self.depth = {}, depth
        for t in texts:
            for ctx, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.counts.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
        self.children = {}
        for ctx, node in self.counts:
            if ctx:
                self.children.setdefault((ctx[1:], node), []).append(ctx)
        self.weighted = {}
        for ctx, node in sorted(self.counts, key=lambda x: -len(x[0])):
            own = kt(*self.counts[ctx, node])
            if len(ctx) == depth:
                self.weighted[ctx, node] = own
            else:
                below = sum(self.weighted[c, node] for c in self.children[ctx, node])
                self.weighted[ctx, node] = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def steps(self, text):
        data = b"\0" * self.depth + bytes(text).lower() + b"\0"
        for k in range(self.depth, len(data)):
            node = 1
            for i in range(8):
                bit = data[k] >> (7 - i) & 1
                yield data[k - self.depth : k], node, bit
                node = 2 * node + bit

    def one(self, ctx, node, depth=0):
        part = ctx[self.depth - depth :]
        if (part, node) not in self.counts:
            return 0.5
        a, b = self.counts[part, node]
        own = (b + 0.5) / (a + b + 1)
        if depth == self.depth:
            return own
        w = math.exp(math.log(0.5) + kt(a, b) - self.weighted[part, node])
        return w * own + (1 - w) * self.one(ctx, node, depth + 1)

    def score(self, text):
        total = 0.0
        for ctx, node, bit in self.steps(text):
            p = self.one(ctx, node)
            total += math.log10(p if bit else 1 - p)
        return total


@pytest.mark.parametrize("depth,rows_at_once,frequent", [(ctw.DEPTH, ctw.GROUP_ROWS, ctw.FREQUENT_WORDS), (3, 500, 3), (7, 100, 300), (1, 20, 0)])
def test_language_model_against_brute_force(docs, no_docs, rows, monkeypatch, depth, rows_at_once, frequent):
    """Once as it is, and with other depths, small groups and few words and contexts broadcast."""
    monkeypatch.setattr(ctw, "GROUP_ROWS", rows_at_once)
    monkeypatch.setattr(ctw, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(ctw, "FREQUENT_GRAMS", frequent)
    df = docs.where("doc_id is null or doc_id <> 8")
    small = [r for r in rows if r[0] != 8]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in small]
    words = [[*WORD.findall((r[1] or "").lower() if (r[1] or "").isascii() else (r[1] or "").replace("A", "a")), "\0end"] for r in small]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    tree = BruteTree([(r[1] or "").encode() for r, h in zip(small, held) if not h], depth)
    want = []
    for r, h, ws in zip(small, held, words):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((str(r[0]), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6), round(tree.score((r[1] or "").encode()), 3)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in ctw.score_documents(df, depth=depth).collect()]
    assert sorted(got) == sorted(want)
    assert ctw.score_documents(no_docs).count() == 0


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = ctw.Lookup(keys, np.arange(len(keys), dtype=float))
    value, known = table(np.concatenate([keys[::-1], keys + np.uint64(1)]))
    assert known[: len(keys)].all() and (value[: len(keys)] == np.arange(len(keys))[::-1]).all() and not known[len(keys) :].any()
    assert not ctw.Lookup(keys[:0], np.empty(0))(keys)[1].any()


def test_predictions_of_a_context_sum_to_one(spark):
    """Seen and new bytes after one context together have probability one."""
    docs = spark.createDataFrame([(k, "abracadabra abba" * 3) for k in range(4)], "doc_id long, text string")
    grams = ctw._count(docs.selectExpr("doc_id", "cast(text as binary) AS text"), 3).where("kind = 1").groupBy("key").sum("n").toDF("key", "n")
    tree = ctw.context_tree(grams, 3)
    after = int.from_bytes(b"bra", "big") << 8
    keys = spark.createDataFrame([(after + b,) for b in range(256)], "key long")
    logs = ctw.new_logs(keys, tree).collect()
    assert len(logs) == 256 and abs(sum(10**r.logs for r in logs) - 1) < 1e-5
    seen = {r.key: r.logs for r in ctw.byte_logs(grams, tree[-1], 10).collect()}
    assert all(abs(seen[r.key] - r.logs) < 1e-5 for r in logs if r.key in seen)


def test_language_model_beats_the_word_base_on_held_out_text(spark):
    """On 25 MB of text; on a tenth of it the word base, which is no distribution, is still ahead (README)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = ctw.score_documents(docs).where("held_out").selectExpr("sum(score) AS score", "sum(base_score) AS base", "sum(bits_per_byte * n_bytes) / sum(n_bytes) AS bits").first()
    assert got.score > got.base and got.bits < 2.2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_patterns_on_random_texts():
    rng = random.Random(5)
    parts = ["a", "b.", "@", "@c", "..", "1", "12", "255", ".", "1.2", "+", "-", " ", "(", "4539578763621486", "%", "é", "٣", "256.", "0255"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 50_000, "1." * 50_000, "@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train_field()


def _share_right(field, table, seed, times=20):
    rng, right, total = random.Random(seed), 0, 0
    for kind, pattern in table:
        for _ in range(times):
            text = pii._filled(pattern, rng)
            low, high = text.find("<"), text.find(">") - 1
            text = text.replace("<", "").replace(">", "")
            found = [s for s in pii.find_spans([text], field)[0][1] if kind is None or (s[1] < high and s[2] > low)]
            total += 1
            right += (not found) if kind is None else any(s[0] == kind for s in found)
    return right / total


def test_field_on_held_out_rows(field):
    assert _share_right(field, pii.LABELLED, 99) > 0.97


#: Forms and words that the training table does not have.
OTHER_FORMS = (
    ("email", "please write to <{w}.{w} at {w} dot org> before noon"), ("email", "reach me: <{w}@{w}>, thanks"),
    ("phone", "fax <({ddd}) {ddd}-{dddd}> or visit us"), ("phone", "mobile <{ddd}-{ddd}-{dddd}>; ask for {W}"), ("phone", "the number is <{ddd}-{ddd}-{dddd}> at night"),
    ("card", "paid with <{luhn}> yesterday"), ("card", "number <{luhn4}>, thanks"),
    ("secret", "export SECRET = <'{h50-60}'>"), ("secret", "set passwd = <{K20-30}> first"), ("secret", "the auth={K20-30} header"), ("secret", "login password: <{k12-18}> now"),
    ("secret", "PASSWORD = <{a12-16}>"), ("secret", "passphrase = <{a12-18}> ok"), ("secret", "API_KEY = <{h120-128}>"),
)
OTHER_PLAIN = (
    (None, "in {dddd} there were {dd} of them"), (None, "chapter {d}, page {ddd}"), (None, "the key of the house"), (None, "what is the secret of {w}?"), (None, "we met at noon, dot by dot"),
    (None, "at {dd}:{dd} on {dd}.{dd}.{dddd}"), (None, "x={d}; y={dd}"), (None, "note: {w} and {w}"), (None, "ratio {d}:{d} for {w}"), (None, "commit {h40-40} fixes it"), (None, "id {dddddddd}"),
)


def test_field_on_other_forms(field):
    assert _share_right(field, OTHER_FORMS, 3) > 0.9
    assert _share_right(field, OTHER_PLAIN, 4) > 0.97


def test_long_words_are_read_whole(field):
    rng = random.Random(8)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(128))
    found = pii.find_spans([f"token = {hexes} end"], field)[0][1]
    assert ("secret", 8, 136) in found
    name = "x" * 100
    text = f"{name}.y@host.example.org and {name}@{name} or password={hexes}"
    kinds = {k: text[a:b] for k, a, b in pii.find_spans([text], field)[0][1]}
    assert kinds["secret"] == hexes and "email" in kinds
    assert pii._shape("9" * 100 + "a" * 100) == "920a" and pii._shape("ab" * 50 + "!") == "a!"
    shapes = [pii._shape("a" * 70 + c) for c in ("!", "1")]
    assert shapes == ["a!", "a9"]


def test_many_marked_words_take_linear_time(field):
    pii.find_spans([" ".join(str(k) for k in range(60_000)), "key " * 20_000, "a=" * 50_000], field)


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(4, len(pii.TAGS)))
    best = max(((e[0, a] + field.moves[0, a] + field.moves[1 + a, b] + e[1, b] + field.moves[1 + b, c] + e[2, c] + field.moves[1 + c, d] + e[3, d]), (a, b, c, d)) for a in range(11) for b in range(11) for c in range(11) for d in range(11))
    assert tuple(field.decode([e])[0].tolist()) == best[1]


def test_personal_data(docs, no_docs, rows, field):
    got = sorted(map(tuple, pii.find_personal_data(docs, field).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()), key=str)
    assert got == sorted([(r[0], *[len(plain_spans(r[1] or "")[k]) for k in pii.BASE_KINDS]) for r in rows], key=str)
    red = pii.redact(docs, field)
    assert red.columns == docs.columns and "[PHONE]" in red.where("doc_id = 1").first().text and red.where("doc_id = 3").first().text is None
    assert pii.find_personal_data(no_docs, field).count() == 0


def test_secret_without_its_name(field):
    text = "and token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" or password=531ccd051a92ebcb68 end"
    spans = pii.find_spans([text], field)[0][1]
    assert [text[a:b] for k, a, b in spans if k == "secret"] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "531ccd051a92ebcb68"]


@pytest.mark.parametrize("text", ["DB_PASSWORD: swordfishabcdef", "client_secret = abcdefghijkl", "access_token: abcdefghijklmnop", "accessToken = qwertyuiopas now"])
def test_secrets_announced_by_a_part_of_a_word(field, text):
    assert [text[a:b] for k, a, b in pii.find_spans([text], field)[0][1]] == [text.split("=")[-1].split(":")[-1].split()[0]]


@pytest.mark.parametrize("text", ["the key-value pairs of everything there", "a monkey: something", "keyboard = something", "the secretary: everything", "tokens: something"])
def test_words_that_announce_nothing(field, text):
    assert pii.find_spans([text], field)[0][1] == []


def test_training_does_not_depend_on_partitions(spark):
    """Repeated ids with other texts, repeated, null and conflicting labels: one weight vector, and the prior of its rows."""
    rng = random.Random(3)
    rows = [(k % 40, " ".join(rng.choice(["good", "BAD", "123", "x#", "word."]) for _ in range(rng.randint(1, 60))), "src", "en") for k in range(160)]
    marks = [(k, k % 3 % 2) for k in range(40)] + [(1, 1), (1, 0), (2, None), (None, 1), (None, 1), (999, 1)] + [(4, 0)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    told = []
    for n in (2, 3, 7):
        weights, rate = quality_bayes.train(docs.repartition(n), labels.repartition(n))
        found = quality_bayes.classify(docs.repartition(n), labels.repartition(n), column="v").select("doc_id", "text", "v.posterior", "v.site_rate")
        told.append((weights.tolist(), rate, sorted(map(tuple, found.collect()))))
    assert told[0] == told[1] == told[2]
    good = {}
    for k, q in marks:
        if k is not None and q is not None and k < 40:
            good[k] = max(good.get(k, 0), q)
    assert told[0][1] == sum(good.values()) / len(good)
    x, y = quality_bayes.training_rows(docs, labels)
    texts = {}
    hashes = {t: h for t, h in docs.selectExpr("text", "xxhash64(text)").collect()}
    for k, text, *_ in rows:
        texts[k] = min(texts.get(k, (2**63, "")), (hashes[text], text))
    want = quality_bayes.features([texts[k][1].encode() for k in sorted(good)])
    assert np.array_equal(x, want.astype(float)) and y.tolist() == [good[k] for k in sorted(good)]
