"""Each operator on odd and empty tables, against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.llm import components, ctw, decontamination, license_scan, line_dedup, packing, quality_gam, quality_rules, sharding, simhash, toxicity
from tests.llm import brute
from tests.llm.conftest import PASSAGE, table


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(map(tuple, rows))


# 1 licence scan


def test_license_base_phrases(odd):
    def places(text, phrase):
        ws, p = brute.words(text), phrase.split()
        return [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]

    got = []
    for r in license_scan.scan(odd).collect():
        base = sorted((s["first"], s["label"]) for s in r["spans"] if s["exact"])
        got.append((r["doc_id"], r["n_words"], str(base)))
    want = []
    for doc_id, text in pairs(odd):
        base = sorted((i, label) for label, phrase in license_scan.BASE.items() for i in places(text, phrase))
        want.append((doc_id, len(brute.words(text)), str(base)))
    assert counted(got) == counted(want)


def test_license_notices_survive_small_changes(spark):
    text = "We say: Permission is hereby granted, free of charge, to any and every person obtaining a copy of this software and documentation files!"
    rows = license_scan.scan(table(spark, [(1, text), (2, "permission to swim is granted")])).collect()
    labels = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in rows}
    assert labels == {1: {"mit-text"}, 2: set()}


def test_license_lowers_only_a_to_z(spark):
    text = "the por\u212a is released under CC BY"  # the Kelvin sign is no k
    assert license_scan.scan(table(spark, [(1, text)])).first()["n_words"] == 7


def test_license_empty_table(empty):
    assert license_scan.scan(empty).count() == 0


# 2 packing


def check_packing(docs, seq_len):
    rows = [r.asDict() for r in packing.pack(docs, seq_len).collect()]
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_document[r["row"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for spans in [*by_sequence.values(), *([s[:2] for s in d] for d in by_document.values())]:
        end = 0
        for start, length in sorted(spans):
            assert start == end and length > 0
            end = start + length
        if spans in by_sequence.values():
            assert end <= seq_len
    assert all(sum(s[1] for s in d) == d[0][2] for d in by_document.values())
    return rows


def test_packing_covers_every_token(odd):
    rows = check_packing(odd, 64)
    exact = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"), None)
    want = Counter()
    for doc_id, text in pairs(odd):
        ids = np.append(exact(text or ""), 1).astype("<u4")
        for k in range(0, len(ids), 64):
            want[doc_id, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


def test_packing_round_trip(odd):
    packed = packing.pack(odd, 64, with_ids=True).collect()
    sequences = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(odd, 64).collect()}
    assert sum(map(len, sequences.values())) == sum(4 * r["length"] for r in packed)
    for r in packed:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_all_pieces(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([1, 2, 3, 64, rng.randint(1, 64)]) for _ in range(rng.randint(1, 3000)))
    intervals, sequences = packing.shortest_pack_first(histogram, 64)
    fill, ranks = Counter(), defaultdict(list)
    for length, rank, n, each, first, offset in intervals:
        assert n % each == 0
        ranks[length].append((rank, n))
        for k in range(n // each):
            assert fill[first + k] == offset
            fill[first + k] += each * length
    assert len(fill) == sequences and max(fill.values()) <= 64
    for length, parts in ranks.items():
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == histogram[length]


def test_both_tokenizers_agree():
    rng = random.Random(1)
    fast = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"), packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"), None)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13, 160, 0x3000, 0x1F600, 0x300, 0x85, 0x661] + list(range(161, 592))]
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randint(0, 80)))
        assert fast(text).tolist() == exact(text).tolist()


def test_packing_empty_table(empty):
    assert packing.pack(empty).count() == 0 and packing.sequences(empty).count() == 0


# 3 quality model, 10 toxicity


def learnable_table(spark, n, bad):
    rng = random.Random(3)
    calm = "river mill wheel summer dusk garden letter window morning paper".split()
    docs, labels = [], []
    for i in range(n):
        mark = rng.random() < 0.4
        text = " ".join(rng.choices(calm, k=60)).capitalize() + "."
        docs.append((i, bad(text, rng) if mark else text))
        labels.append((i, mark))
    return table(spark, docs), labels


def accuracy(scored, labels, good):
    truth = {i: good(mark) for i, mark in labels}
    rows = [r for r in scored.collect() if brute.remainder(r["doc_id"], 3) == 1]
    assert all(0 <= r["score"] <= 1 for r in rows)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_quality_learns_held_out(spark):
    docs, labels = learnable_table(spark, 600, lambda t, rng: "! ".join(t.upper().split()) if rng.random() < 0.5 else " ".join([t.split()[0]] * 50))
    known = spark.createDataFrame([(i, int(not m), 0) for i, m in labels], "doc_id long, quality int, toxic int")
    assert accuracy(quality_gam.scores(docs, known), labels, lambda m: int(not m)) > 0.98


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(5)
    values = rng.random((4000, 3))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(values, labels)
    assert ((model.score(values) > 0.5) == labels).mean() > 0.95 and (0, 1) in model.pairs


def test_toxicity_learns_held_out(spark):
    def insult(text, rng):
        ws = text.split()
        for _ in range(4):
            ws.insert(rng.randrange(len(ws)), rng.choice(["fool", "rotter", "rotting", "rotten"]))
        return " ".join(ws)

    docs, labels = learnable_table(spark, 600, insult)
    known = spark.createDataFrame([(i, 1, int(m)) for i, m in labels], "doc_id long, quality int, toxic int")
    assert accuracy(toxicity.scores(docs, known), labels, int) > 0.97
    kept = {r["doc_id"] for r in toxicity.keep_civil(docs, known).collect()}
    assert kept >= {i for i, m in labels if not m} and len(kept) < 420
    assert toxicity.keep_civil(docs, known).columns == docs.columns


def test_lexicon_hits_the_words_it_was_learned_from(spark):
    rows = [(f"plain words ÄRGER number {i}", 1) for i in range(9)] + [(f"plain words number {i}", 0) for i in range(9)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert "Ärger" in lexicon and "ärger" not in lexicon  # only A-Z are lowered
    assert dict(zip(toxicity.FEATURES, toxicity.describe("ÄRGER", lexicon)))["hits_any"] == 1


def test_toxicity_features():
    lexicon = {"idiot": 5.0, "loser": 6.0, "lowei~": 4.0}
    text = "You utter l0s3r!! aaargh SSSTOP loweing, yyy (idiot)"
    f = dict(zip(toxicity.FEATURES, toxicity.describe(text, lexicon)))
    n = len(brute.words(text))
    assert n == 8 and f["hits_any"] * n == 2 and f["hits_strong"] * n == 1 and f["most_weight"] == 5
    assert f["person"] * n == 1 and f["near_person"] * n == pytest.approx(1) and f["exclamations"] * n == 2
    assert f["obfuscated"] * n == 2 and f["unmasked"] * n == 1 and f["stretched"] * n == 3 and f["shouted"] * n == 1
    assert toxicity.describe("", lexicon) == [0.0] * len(toxicity.FEATURES)
    assert len(toxicity.describe("a" * 200_000, lexicon)) == len(toxicity.FEATURES)  # no step is quadratic


@pytest.mark.parametrize("scores", [quality_gam.scores, toxicity.scores])
def test_scores_of_odd_and_empty_tables(spark, odd, empty, no_labels, scores):
    one_kind = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (no_labels, one_kind):
        rows = scores(odd, labels).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in pairs(odd))
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert scores(empty, labels).count() == 0


# 4 decontamination


def test_contamination_matches_brute_force(spark, odd):
    bench = [("a", PASSAGE), ("b", "twice here"), ("c", ""), ("d", None), (None, "another text"), ("b", "same id"), ("e", "no such thing")]
    items = spark.createDataFrame([(i, t, 1, "z") for i, t in bench], "item_id string, text string, row int, doc_id string")
    short = [(i, t) for i, t in pairs(odd) if not t or len(t) < 10_000]
    docs = table(spark, short)
    want = counted((i, n, h, brute.digest(f)) for i, t in short for n, h, f in [brute.contamination(t, bench)])
    for block_words in (decontamination.BLOCK_WORDS, 10):
        rows = decontamination.contamination(docs, items, block_words=block_words).withColumn("n_hit", decontamination.hit_words("spans")).collect()
        got = counted((r["doc_id"], r["n_words"], r["n_hit"], brute.digest({s["item_id"] for s in r["spans"]})) for r in rows)
        assert got == want
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert counted(pairs(kept)) == counted((i, t) for i, t in short if not brute.contamination(t, bench)[1])


def test_contamination_random_texts(spark):
    rng = random.Random(11)
    letters = "a b c d".split()
    docs = [(i, " ".join(rng.choices(letters, k=rng.randint(0, 80)))) for i in range(60)]
    bench = [(str(k), " ".join(rng.choices(letters, k=rng.choice([3, 5, 6])))) for k in range(8)]
    items = spark.createDataFrame(bench, "item_id string, text string")
    rows = decontamination.contamination(table(spark, docs), items, width=4).withColumn("n_hit", decontamination.hit_words("spans")).collect()
    assert {(r["doc_id"], r["n_hit"]) for r in rows} == {(i, brute.contamination(t, bench, 4)[1]) for i, t in docs}


def test_proximity(spark):
    items = spark.createDataFrame([("p", "zebra meets quagga")], "item_id string, text string")
    docs = table(spark, [(1, "the zebra that now and then meets a quagga"), (2, "zebra " + "x " * 40 + "quagga"), (3, "quagga, zebra"), (4, None), (5, "meets " * 9)])
    rows = decontamination.contamination(docs, items, distance=10).collect()
    spans = {r["doc_id"]: [(s["first"], s["last"]) for s in r["spans"]] for r in rows}
    assert set(spans) == {1, 2, 3, 4, 5} and spans[2] == spans[4] == spans[5] == [] and spans[3] == [(0, 1)] and len(spans[1]) == 1


def test_contamination_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([], "item_id string, text string")
    rows = decontamination.contamination(odd, items).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    assert decontamination.contamination(empty, items).count() == 0


def test_search_reads_only_lists_it_asks_for(spark):
    texts = [(1, "AA bb cc_dd éÉ aa"), (2, ""), (3, "x y z " * 400 + "bb cc dd"), (4, "bb cc\u00a0dd"), (5, "dd")]
    vocabulary = {w: k for k, w in enumerate(["aa", "bb", "cc", "dd", "x", "y", "z", "éÉ"])}
    batch = decontamination.index(table(spark, texts).withColumn("row", F.col("doc_id")), vocabulary).orderBy("row").toArrow()
    lists = [column.combine_chunks() for column in (batch.column("terms"), batch.column("places"))]
    found = list(decontamination.documents_of(*lists))
    assert batch.column("n_words").to_pylist() == [6, 0, 1203, 2, 1]
    assert {t: found[0][t] for t in found[0].keys()} == {0: [0, 5], 1: [1], 2: [2], 3: [3], 7: [4]}
    assert list(found[1].keys()) == [] and {t: found[3][t] for t in found[3].keys()} == {1: [0]}
    query = decontamination.Phrases({7: [1, 2, 3]}, {1: 2, 2: 3, 3: 4}, 10)
    cut = list(decontamination.documents_of(*(x.slice(2) for x in lists)))
    assert query.search(cut[0]) == [(7, 1200, 1202)] and set(cut[0].read) == {1, 2, 3} and len(cut[0].keys()) == 6


# 5 SimHash


def test_simhash_matches_brute_force(odd):
    want_prints = {t: brute.fingerprint(t) for _, t in pairs(odd)}
    rows = simhash.near_duplicates(odd).collect()
    texts = pairs(odd)
    prints = [want_prints[t] for _, t in texts]
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in rows) == Counter((i, p) for (i, _), p in zip(texts, prints))
    groups = brute.near_groups(prints)
    least = {g: min((i for (i, _), h in zip(texts, groups) if h == g and i is not None), default=None) for g in groups}
    want = Counter((i, p, least[g]) for (i, _), p, g in zip(texts, prints, groups))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == want
    assert sum(r["stays"] for r in rows) == len(set(groups))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(groups))


def test_links_of_hot_and_cold_groups(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for seed in seeds:
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                prints.add(seed ^ (1 << b))
    hub = rng.getrandbits(64)
    for _ in range(900):
        p = hub
        for b in rng.sample(range(24), rng.randint(0, 7)):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(fps)).collect()}
    a = np.array(prints, np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3)[0]:
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    want, got = defaultdict(set), defaultdict(set)
    for i, p in enumerate(signed):
        want[find(i)].add(p)
        got[roots.get(p, p)].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert roots == {k: 0 for k in range(301)}


def test_simhash_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# 6 quality rules


def test_rules_base(odd, no_labels):
    rows = quality_rules.judge(odd, no_labels).collect()
    got = counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == counted((i, *brute.base_quality(t)) for i, t in pairs(odd))
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["rule"] is None and r["kept"] == (not failed)


def test_rules_learn_a_conjunction(spark):
    def junk(text, rng):
        return " ".join(w.upper() + "$$" for w in text.split())

    docs, labels = learnable_table(spark, 600, junk)
    known = spark.createDataFrame([(i, int(not m), 0) for i, m in labels], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, known).collect() if not r["base_failed"]}
    assert all(kept[i] == (not m) for i, m in labels if i in kept) and len(kept) > 300


def test_rules_empty_table(empty, no_labels):
    assert quality_rules.judge(empty, no_labels).count() == 0


# 7 line dedup


def cut_windows(texts):
    doc, first, end, value, _ = (x.tolist() for x in line_dedup.Cut(texts).windows())
    found = [[] for _ in texts]
    for d, a, b, h in zip(doc, first, end, value):
        found[d].append((a, b, h))
    return found


def test_windows_match_brute_force(odd):
    rng = random.Random(4)
    marks = ["a", "bb.", "c!", "déjà", "\u0435\u0449\u0451", "\u4e2d\u6587", "\u3002", "\u0936\u092c\u094d\u0926\u0964", "\u0642\u061f", "x\u4e00y", "\U00020001", "\U0001f600", ".", "\x00", "\u00a0"]
    texts = ["".join(w + rng.choice([" ", " ", " ", "\n", "  ", "", "\t"]) for w in rng.choices(marks, k=rng.randint(0, 90))) for _ in range(60)]
    texts += [t[:1500] for _, t in pairs(odd) if t] + ["", " ", "\n\n", "word " * 100, "w%d " * 60 % tuple(range(60))]
    hashes = {}
    for text, got in zip(texts, cut_windows(texts)):
        want = brute.line_windows(text, needed=True)
        assert sorted((a, b) for a, b, _ in got) == [(a, b) for a, b, _ in want], text
        for (_, _, h), (_, _, ws) in zip(sorted(got), want):
            assert hashes.setdefault(h, ws) == ws
    assert len(set(hashes.values())) == len(hashes)  # equal words have one hash, wherever they stand


def test_line_dedup_matches_brute_force(spark, odd, monkeypatch):
    passage = PASSAGE.replace(". ", ".\n")
    more = [(20, f"New start.\n{passage}\nNew end."), (21, "One line of ten words, as it happens, right here. " * 9), (0, PASSAGE)]
    docs = table(spark, [(i, t and t[:2500]) for i, t in pairs(odd)] + more)
    order = sorted(enumerate(pairs(docs)), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))
    kept = brute.kept_texts([(k, t) for k, (_, t) in order], needed=False)
    want = Counter((i, None if t is None else kept[k], None if t is None else len(t)) for k, (i, t) in enumerate(pairs(docs)))
    done = line_dedup.remove_repeats(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in done.collect()) == want
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[0] == PASSAGE and texts[8] == "" and texts[7] == "Opening words. Closing words."
    for r in done.collect():
        lines = brute.cut_lines(r["text"] or "")[0] if r["n_removed"] == 0 else None
        assert lines is None or len(lines) == r["n_lines"]
    # a table of repeated windows that is full lets every window through
    monkeypatch.setattr(line_dedup, "BITS", 8)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.remove_repeats(docs).collect()) == want


def repeated_runs_removed(texts):
    """Texts cut into lines by hand; every run of 3 lines and 10 words that came before goes."""
    seen, out = set(), []
    for lines in texts:
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 3, len(lines) + 1):
                run = tuple(" ".join(x) for x in lines[a:b])
                if sum(map(len, lines[a:b])) >= 10:
                    gone.update(range(a, b) if run in seen else ())
                    seen.add(run)
        out.append([x for i, x in enumerate(lines) if i not in gone])
    return out


def test_line_dedup_finds_passages_of_short_lines(spark):
    rng = random.Random(7)
    menu = [[f"dish{i}"] for i in range(40)]
    verse = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 1, 2, 9]))] for _ in range(60)]
    spaced = [menu, [["first"], *menu[5:25], ["last"]], menu[:9], menu, verse, [["so"], *verse[7:31], *menu[:12]], verse[3:6] + verse[40:]]
    chinese = [[chr(0x4E00 + rng.randrange(500)) for _ in range(6)] for _ in range(12)]
    unspaced = [chinese, [["\u4e00"] * 3, *chinese[2:9]]]
    docs = ["\n".join(" ".join(x) for x in lines) for lines in spaced] + ["\n".join("".join(x) for x in lines) for lines in unspaced]
    want = [[" ".join(x) for x in lines] for lines in repeated_runs_removed(spaced)] + [["".join(x) for x in lines] for lines in repeated_runs_removed(unspaced)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(table(spark, list(enumerate(docs)))).collect()}
    assert [got[i].split("\n") if got[i] else [] for i in range(len(docs))] == [[*x, ""] if x and got[i].endswith("\n") else x for i, x in enumerate(want)]
    assert got[1] == "first\nlast" and got[2].split() == [f"dish{i}" for i in range(9)] and got[3] == "" and got[8] == "\u4e00" * 3 + "\n"


def test_line_dedup_finds_any_fifty_words():
    """Word-level: after the first text, no 50 words in a row of an earlier text stay, however they are placed."""
    rng = random.Random(3)

    def prose(n, spaced=True):
        return [f"v{rng.randrange(3000)}" if spaced else chr(0x4E00 + rng.randrange(3000)) for _ in range(n)]

    for spaced in (True, False):
        for _ in range(150):
            passage = prose(50, spaced)
            for k in rng.sample(range(50), rng.choice([0, 0, 1, 2])):
                passage[k] += "." if spaced else "\u3002"
            texts = [(" " if spaced else "").join([*prose(rng.randrange(30), spaced), *passage, *prose(rng.randrange(30), spaced)]) for _ in range(2)]
            kept = kept_by_cut(texts)
            assert kept[0] == texts[0]
            assert len(texts[1]) > len(kept[1]) and (" " if spaced else "").join(passage) not in kept[1]
    one = " ".join(prose(160))
    two = "Only eight words are in here so far. And three."
    assert kept_by_cut([one, one, two, two])[1::2] == ["", ""]


def kept_by_cut(texts):
    """The operator's windows and removal, first occurrences found by hand."""
    seen, spans = set(), []
    for k, found in enumerate(cut_windows(texts)):
        spans += [(k, a, b) for a, b, h in found if h in seen or seen.add(h)]
    doc, first, end = np.array(spans, np.int64).reshape(-1, 3).T
    return line_dedup.Cut(texts).without(doc, first, end)[0]


def test_line_dedup_empty_table(empty):
    assert line_dedup.remove_repeats(empty).count() == 0


# 8 language model


def test_scores_match_the_definition(odd):
    docs = odd.withColumn("held", ctw.held_out())
    rows = ctw.scores(odd, docs.filter("not held")).collect()
    texts = [(i, t or "") for i, t in pairs(odd)]
    counts = Counter()
    for i, t in texts:
        if brute.remainder(i, 7) != 2:
            counts.update([*brute.TOKEN.findall(brute.lower(t)), None])
    total, different = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        ws = [*brute.TOKEN.findall(brute.lower(t)), None]
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in ws)
        want.append((i, len(t.encode()) + 1, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 6)))
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert Counter(got) == Counter(want)
    assert all(r["score"] < 0 for r in rows)


def test_tree_is_context_tree_weighting():
    """Against the recursion on sequences, for all contexts of a tiny corpus."""
    texts = ["abab abba", "abba baab aab", "bbb aa"]
    counts = Counter()
    for t in texts:
        for key in ctw._keys(ctw._coded(t)).tolist():
            counts[key] += 1
    by = defaultdict(lambda: np.zeros(256))
    for key, n in counts.items():
        for d in range(ctw.DEPTH + 1):
            by[d, key >> 8 & ((1 << 8 * d) - 1)][key & 255] += n
    contexts = sorted(c for c in by if c[0])
    tree = ctw.Tree(contexts, np.array([by[c] for c in [(0, 0), *contexts]]))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def at(context, node, levels):
        """Zeros and ones at a node of the byte's tree: ``levels`` bits are known."""
        lo = (node << (8 - levels)) & 255
        half = 1 << (7 - levels)
        c = by[context] if context in by else np.zeros(256)
        return c[lo : lo + half].sum(), c[lo + half : lo + 2 * half].sum()

    def weighted(context, node, levels):
        own = kt(*at(context, node, levels))
        below = [c for c in contexts if c[0] == context[0] + 1 and c[1] & ((1 << 8 * context[0]) - 1) == context[1]]
        if not below:
            return own
        return np.logaddexp(own, sum(weighted(c, node, levels) for c in below)) - math.log(2)

    def one(path, node, levels):
        """Chance of a one after ``path``: the contexts from the root on that the tree has."""
        context = path[0]
        a, b = at(context, node, levels)
        own = (b + 0.5) / (a + b + 1)
        if not any(c[0] == context[0] + 1 and c[1] & ((1 << 8 * context[0]) - 1) == context[1] for c in contexts):
            return own
        stop = math.exp(kt(a, b) - math.log(2) - weighted(context, node, levels))
        return stop * own + (1 - stop) * (one(path[1:], node, levels) if len(path) > 1 else 0.5)

    total, text = 0.0, "abbab c"
    coded = ctw._coded(text)
    for t in range(ctw.DEPTH, len(coded)):
        path = [(0, 0)]
        for d in range(1, ctw.DEPTH + 1):
            number = 0
            for x in coded[t - d : t]:
                number = number << 8 | int(x)
            if (d, number) not in by:
                break
            path.append((d, number))
        node = 1
        for level in range(8):
            bit = int(coded[t]) >> (7 - level) & 1
            p = one(path, node & ((1 << level) - 1), level)
            total += math.log10(p if bit else 1 - p)
            node = node << 1 | bit
    assert tree.log10(text) == pytest.approx(total, rel=1e-4)


def test_tree_beats_chance_and_sums_to_one(spark):
    docs = table(spark, [(i, PASSAGE) for i in range(30)])
    rows = ctw.scores(docs, docs).collect()
    assert -rows[0]["score"] / math.log10(2) / rows[0]["n_bytes"] < 1.5
    tree = ctw.grow(ctw.count(docs).filter("kind = 1").select("key", "n"))
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("frequent", [500, 1 << 19])
def test_scores_use_every_context(spark, monkeypatch, frequent):
    """More contexts than any fixed tree of 16,384 had, also of rare scripts; some texts hold unseen ones."""
    monkeypatch.setattr(ctw, "FREQUENT_KEYS", frequent)
    rng = random.Random(11)
    words = ["".join(chr(rng.choice([97, 0x430, 0x5D0, 0x4E00]) + rng.randrange(26)) for _ in range(rng.randrange(2, 7))) for _ in range(1500)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(40)] + ["", "unseen \U0001f600 zzz", words[0]]
    train = table(spark, list(enumerate(texts[:40])))
    by = defaultdict(lambda: np.zeros(256))
    for t in texts[:40]:
        for key in ctw._keys(ctw._coded(t)).tolist():
            for d in range(ctw.DEPTH + 1):
                by[d, key >> 8 & ((1 << 8 * d) - 1)][key & 255] += 1
    contexts = sorted(c for c in by if c[0])
    assert len(contexts) > 1 << 14
    tree = ctw.Tree(contexts, np.array([by[c] for c in [(0, 0), *contexts]]))
    got = {r["doc_id"]: r["score"] for r in ctw.scores(table(spark, list(enumerate(texts))), train).collect()}
    assert got == {i: pytest.approx(tree.log10(t), rel=1e-4) for i, t in enumerate(texts)}


def test_scores_without_training(odd, empty):
    rows = ctw.scores(odd, empty).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert all(r["score"] == pytest.approx(-8 * math.log10(2) * r["n_bytes"], rel=1e-5) for r in rows)
    assert ctw.scores(empty, empty).count() == 0


# 9 sharding


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_whole_and_balanced(odd, shards):
    rows = sharding.assign(odd, shards).collect()
    texts = [(i, t or "") for i, t in pairs(odd)]
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_bounded_loads_move_little():
    rng = random.Random(4)
    counts = Counter(rng.randrange(1 << sharding.CELL_BITS) for _ in range(20_000))

    def owners(shards):
        return {(c, k): s for c, a, b, s, _ in sharding.walk(counts, shards, 0.25) for k in range(a, b)}

    before, after = owners(24), owners(25)
    assert len(before) == len(after) == 20_000
    assert max(Counter(before.values()).values()) <= math.ceil(1.25 * 20_000 / 24)
    assert sum(before[k] != after[k] for k in before) < 0.25 * 20_000


def test_sharding_empty_table(empty):
    assert sharding.assign(empty).count() == 0
