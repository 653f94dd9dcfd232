"""Alignment, token counts and resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from poolsift.llm import alignment, encoding, packing, resampling, token_counts
from tests.llm import brute
from tests.llm.conftest import PASSAGE, table

PATH = public_tokenizers.path
EXTRA = [
    (30, "tabs\tand\r\nbreaks  and   spaces "),
    (31, "▁ is the piece for a space,   is not"),
    (32, "<s>no token</s> <unk> <0x41> <|endoftext|> twice <|endoftext|>"),
    (33, " leading and trailing "),
    (34, "Donaudampfschifffahrtsgesellschaft aaaaaaaaaaaa 1234567890 中文字 é \U0001f600\U0001f600"),
    (35, " "),
    (36, PASSAGE),
]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def wide(spark, odd):
    return table(spark, pairs(odd) + EXTRA)


# 11 alignment


def plain_alignment(rows):
    """Digest rows and pair counts by comparing all tokens of a text."""
    a_model, b_model = Tokenizer.from_file(PATH("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=PATH("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    name = {i: x for x, i in a_model.get_vocab().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    byte = {c: b for b, c in char.items()}
    texts, counts = [], Counter()
    for doc_id, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        sides = []
        for ids, spell in ((a, lambda i: bytes(byte[c] for c in name[i])), (b, lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode())):
            spans, end = [], 0
            for i in ids:
                spans.append((end, end + len(spell(i)), i))
                end = spans[-1][1]
            sides.append((spans, b"".join(map(spell, ids))))
        whole = (" " + (text or "")).encode()
        if not text or sides[0][1] != whole or sides[1][1] != whole:
            texts.append((doc_id, [], [], []))
            continue
        first, second = sides[0][0], sides[1][0]
        links, k = [], 0
        for x, y, i in first:
            while second[k][1] <= x:
                k += 1
            m = k
            while m < len(second) and second[m][0] < y:
                links.append((i, second[m][2]))
                m += 1
        counts.update(links)
        texts.append((doc_id, first, second, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, first, second, links in texts:
        cuts, groups = sorted({y for _, y, _ in first} & {y for _, y, _ in second}), []
        for x, y in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for p, q, i in side if x <= p and q <= y) for side in (first, second)))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc_id, len(first), len(second), len(groups), len(links), best, sum(counts[p] for p in links), sha))
    return out, {(i, j, n, n == most[j]) for (i, j), n in counts.items()}


@pytest.mark.parametrize("head", [0, 3, alignment.HEAD])
def test_alignment_matches_brute_force(spark, wide, head):
    short = table(spark, [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in pairs(wide)])
    digests, links = alignment.align(short, head=head)
    assert digests.columns == ["doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256"]
    want, want_links = plain_alignment(pairs(short))
    assert Counter(map(tuple, digests.collect())) == Counter(want)
    assert set(map(tuple, links.collect())) == want_links
    assert any(r[3] for r in want) and any(r[1] and r[0] == 34 for r in want)


def test_alignment_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    digests, links = alignment.align(docs, head=500)
    want, want_links = plain_alignment(pairs(docs))
    assert Counter(map(tuple, digests.collect())) == Counter(want) and set(map(tuple, links.collect())) == want_links


def test_alignment_empty_table(empty):
    digests, links = alignment.align(empty)
    assert digests.count() == 0 and links.count() == 0


# 12 token counts


@pytest.mark.parametrize("tokenizer", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("batch_bytes,long", [(1, 5), (700, 40), (encoding.BATCH_BYTES, encoding.LONG)])
def test_token_counts_match_the_library(wide, tokenizer, batch_bytes, long):
    if tokenizer.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=PATH(tokenizer))
        plain = lambda text: len(model.encode(text))
    else:
        model = Tokenizer.from_file(PATH(tokenizer))
        plain = lambda text: len(model.encode(text, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(wide, tokenizer, 12, batch_bytes=batch_bytes, long=long).collect()
    want = Counter((i, len((t or "").encode()), plain(t or ""), plain(t or "") > 12) for i, t in pairs(wide))
    assert Counter(map(tuple, rows)) == want


@pytest.mark.parametrize("tokenizer", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_cuts_change_no_count(tokenizer):
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "a", "I'm", "don't", "word", "Wörter", "1234", "...", "é", "é", "中文", " ", "▁", "<s>", "<|endoftext|>", "\U0001f600"]
    lengths = encoding.counter(PATH(tokenizer))
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(400)]
    assert lengths(texts, 3).tolist() == lengths(texts, 1 << 20).tolist()
    assert any(len(encoding.safe_pieces(t, True, 3)) > 2 for t in texts)
    assert all("".join(encoding.safe_pieces(t, True, 3)) == t and " ".join(encoding.safe_pieces(t, False, 3)) == t for t in texts)


def test_token_counts_empty_table(empty):
    assert token_counts.count_tokens(empty).count() == 0


# 2 packing: the contract's tokenizer


def test_packing_reads_special_strings_as_the_library_does(spark):
    text = "x <|endoftext|> y"
    docs = table(spark, [(1, text), (2, "plain text")])
    model = Tokenizer.from_file(PATH("byte_bpe_50k.json"))
    want = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in pairs(docs)}
    assert want[1] == [87, 220, 50256, 331, 1]
    crc = {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) for i, ids in want.items()}
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.pack(docs).collect()}
    assert got == {i: (len(ids), crc[i]) for i, ids in want.items()}


# 13 resampling


def plain_resampling(rows, target, percent, least, most, buckets, min_words):
    def features(text):
        own = brute.words(text)
        runs = [" ".join(own[k : k + n]) for n in range(least, most + 1) for k in range(len(own) - n + 1)]
        return len(own), [zlib.crc32(x.encode()) % buckets for x in runs]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for k, (doc_id, text) in enumerate(rows):
        n, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None, n >= min_words])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("least,most,percent,min_words", [(1, 1, 10, 20), (1, 2, 50, 1), (2, 3, 100, 4), (1, 1, 0, 0)])
@pytest.mark.parametrize("head", [0, 7, resampling.HEAD])
def test_resampling_matches_brute_force(spark, wide, monkeypatch, least, most, percent, min_words, head):
    monkeypatch.setattr(resampling.frequent_runs, "__defaults__", (resampling.SAMPLE_ROWS, head))
    goal = [PASSAGE, "the mill and the river", None, ""]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(goal)], "item_id long, text string, row int")
    got = resampling.resample(wide, target, percent, least, most, 101, min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_resampling(pairs(wide), goal, percent, least, most, 101, min_words))


def test_resampling_of_empty_tables(wide, empty):
    assert resampling.resample(empty, wide).count() == 0
    rows = resampling.resample(wide, empty).collect()
    assert len(rows) == wide.count()
