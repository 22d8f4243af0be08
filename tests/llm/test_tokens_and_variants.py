"""Packing, alignment and spelling variants against the libraries and brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from litspark.llm import alignment, packing, token_ids, variants
from litspark.llm.queries import QUERIES, table
from litspark.llm.token_counts import byte_of_letter

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "  two  blanks  ", "tab\there\r\nthere", "don't they'll 'twas 's '' it's'd I'VE 1's 'x rock'n'roll",
    "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>c", "<s></s> <unk> <0x41>", "こんにちは kana カタ \U0001f600\U0001f680 emoji", "é combining İstanbul ΣΑΣ ǅ",
    "▁ mark ▁▁x", "nul\0inside", "1234567 3.14 x2y", "no break  em　wide  ogham ​zero ﻿bom", "مرحبا שלום नमस्ते", "x" * 3000,
    "line\n\n\n  indented\n\tcode {}", "“quoted” — dash… end", "éè Über straße ñ", "a\x85b c\x1cd", "same text", "same text", "word " * 5000,
]
RANDOM = "ab e'éß \n\t.,1中あ  \U0001f600▁ś<|"


def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice(RANDOM) for _ in range(rnd.randrange(40))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k % 7 else None, t, "en", 1) for k, t in enumerate(texts())]
    clash = {c: F.lit(7) for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "text_", "block_", "n_a", "pairs", "word", "n", "rank")}
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, x int").repartition(4).withColumns(clash)


# ---- packing


def plain_pieces(rows, capacity=4096, end=1):
    tokenizer, out = Tokenizer.from_file(WORD), Counter()
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        for at in range(0, len(ids), capacity):
            x = ids[at : at + capacity]
            out[(key, at // capacity, at, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x)))] += 1
    return out


def check_packed(rows, want, capacity=4096):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = plain_pieces(docs)
    used = check_packed(QUERIES["op11_packing"](spark, SF).collect(), want)
    assert used <= 1.02 * -(-sum(k[3] * n for k, n in want.items()) // 4096) + 1


@pytest.mark.parametrize("capacity", [4096, 64, 5])
def test_packing_of_odd_texts(spark, odd, capacity):
    want = plain_pieces([(r.doc_id, r.text) for r in odd.collect()], capacity)
    check_packed(packing.pack(odd, WORD, capacity=capacity).collect(), want, capacity)


def test_pieces_give_their_ids(spark, odd):
    rows = packing.token_pieces(odd.select("doc_id", "text"), WORD, capacity=32, ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 37, 100])
    lengths = [min(capacity, 1 + int(rnd.expovariate(rnd.choice([0.05, 0.2])))) for _ in range(rnd.randrange(1, 400))] + [rnd.randrange(1, capacity + 1)] * rnd.randrange(50)
    plan = packing.best_fit(Counter(lengths), capacity)
    held, places = Counter(), defaultdict(list)
    for n, count in Counter(lengths).items():
        for s, o in zip(*(x.tolist() for x in plan.slots(np.full(count, n), np.arange(count)))):
            held[s] += n
            places[s].append((o, n))
    assert sorted(capacity - v for v in held.values()) == plain_best_fit(lengths, capacity)
    assert len(held) == plan.sequences
    for p in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and min(p)[0] == 0


def test_plan_does_not_grow_with_counts():
    rnd = random.Random(1)
    shape = {n: 1 + int(1e4 / n) for n in rnd.sample(range(1, 4097), 900)}
    small, large = (packing.best_fit({n: c * k for n, c in shape.items()}) for k in (1, 100_000))
    assert len(large.length) < 1.5 * len(small.length) + 4096
    with pytest.raises(ValueError):
        packing.best_fit({5000: 1})


def test_common_lengths_are_numbered_in_blocks(spark):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).alias("length"))
    got = packing.best_fit_slots(rows, 60, block_rows=16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 900
    assert sum(r.length for r in got) / 60 <= len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 60 * 1.05 + 1
    assert packing.best_fit_slots(rows.limit(0), 60).count() == 0


# ---- alignment


def plain_alignment(rows):
    import sentencepiece

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    byte, name = byte_of_letter(), {v: k for k, v in a.get_vocab().items()}
    a_bytes = lambda i: bytes(byte[c] for c in name[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(map(a_bytes, x)) != whole or b"".join(map(b_bytes, y)) != whole:
            out.append((key, 0, 0, [], [], ""))
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, x), (b_bytes, y))]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        counts.update(links)
        out.append((key, len(x), len(y), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, q), n in counts.items():
        top[q] = max(top[q], n)
    return Counter((k, n, m, len(g), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), h) for k, n, m, g, ls, h in out)


def found(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert found(QUERIES["op12_alignment"](spark, SF)) == plain_alignment(docs)


@pytest.mark.parametrize("heavy", [10**6, 300, 0])
def test_alignment_of_odd_texts(spark, odd, heavy):
    """With all pair counts broadcast, some, and none."""
    got = found(alignment.token_alignment(odd, BYTE, PIECE, heavy_pairs=heavy))
    assert got == plain_alignment([(r.doc_id, r.text) for r in odd.collect()])


@pytest.mark.parametrize("work", [1, 2, 3, 64, 10**4])
def test_merge_path_finds_every_overlap(work):
    rnd = random.Random(work)
    for n in (0, 1, 5, 400):
        end = 3 * n
        a, b = (np.array(sorted({end, *rnd.sample(range(1, end + 1), n)}) if n else [], np.int64) for _ in range(2))
        got = alignment.merge_path(a, b, work)
        spans = [list(zip([0, *x[:-1].tolist()], x.tolist())) for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        assert list(zip(got.a.tolist(), got.b.tolist())) == want
        assert got.closes.tolist() == [spans[0][i][1] == spans[1][j][1] for i, j in want]
        assert got.group.tolist() == (np.cumsum(got.closes) - got.closes).tolist()


def test_split_points_lie_on_the_path():
    rnd = random.Random(8)
    a, b = (np.array(sorted(rnd.sample(range(1000), n))) for n in (300, 120))
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    diagonals = np.arange(0, 421, 7)
    assert alignment.split_points(a, b, diagonals).tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals]


def test_overlaps_are_spans_of_the_text(spark):
    docs = spark.createDataFrame([(1, "unbelievable héllo"), (2, None), (3, "x y")], "doc_id long, text string")
    rows = alignment.token_overlaps(docs, BYTE, PIECE).orderBy("doc_id", "start").collect()
    for key, text in ((1, "unbelievable héllo"), (3, "x y")):
        own = [r for r in rows if r.doc_id == key]
        assert [(r.start, r.end) for r in own] == list(zip([0, *(r.end for r in own[:-1])], [r.end for r in own]))
        assert own[-1].end == len(text.encode()) + 1 and own[-1].link and own[0].group == own[0].a_at == own[0].b_at == 0
        assert [b.group - a.group for a, b in zip(own, own[1:])] == [int(a.link) for a in own[:-1]]
    assert not any(r.doc_id == 2 for r in rows)


# ---- spelling variants


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    at = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            at[w[:k] + w[k + 1 :]].add(w)
        at[w].add(w)
    near = {w: {v for k in range(len(w)) for v in at[w[:k] + w[k + 1 :]] | at[w] if v != w and one_apart(v, w)} for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def listed(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = listed(QUERIES["op13_variants"](spark, SF))
    assert got == plain_variants(plain_words(docs)) and any(r[3] for r in got)


def test_words_of_odd_texts(spark, odd):
    more = [(5000, " ".join(["Straße straßE Étés éTés ×××÷÷ abcĀdef x·yzzzz"] * 3)), (None, "Letter letters Letter lettes " * 40), (5002, "q" * 9000)] + [(6000 + k, "q" * 9000) for k in range(4)]
    both = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = plain_words([(r.doc_id, r.text) for r in both.collect()])
    assert {r.word: r.n for r in variants.word_counts(both).collect()} == want and "q" * 9000 in want
    assert variants.corpus_variants(both.limit(0)).count() == 0
    listed(variants.corpus_variants(both))


@pytest.mark.parametrize("letters, longest, n", [("ab", 7, 400), ("abc", 5, 300), ("a", 70, 60), ("abéz", 9, 900)])
def test_variants_of_dense_words(spark, letters, longest, n):
    """Words with runs of equal letters, full ranges and long chains of forms."""
    rnd = random.Random(n)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest + 1))): int(2 ** rnd.uniform(0, 14)) for _ in range(n)}
    words |= {"ab" * 32 + "a" * k + t: 3 ** (k + 1) for k in range(4) for t in ("", "b", "c")}  # about the length where keys become digests
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert listed(variants.spelling_variants(df)) == plain_variants(words)


def test_long_keys_name_the_same_ranges():
    rnd = random.Random(4)
    for n in (1, 2, 9, 30):
        word = "".join(rnd.choice("abé") for _ in range(n))
        plain, digests = variants.rotation_ranges(word), variants._long_keys(word)
        other = word[: n // 2] + "z" + word[n // 2 :]
        plain_o, digests_o = variants.rotation_ranges(other), variants._long_keys(other)
        for p, d in zip(plain, digests):
            assert len(set(p)) == len(set(d)) == len(p)
        assert [p in plain_o[1] for p in plain[0]] == [d in digests_o[1] for d in digests[0]]


# ---- ids of strings


def test_memo_forgets_and_relearns():
    asked = []

    def encode(values):
        asked.extend(values)
        return np.array([ord(c) for v in values for c in v], np.int32), np.array([len(v) for v in values])

    memo = token_ids.Memo(encode, entries=4)
    rnd = random.Random(0)
    for _ in range(50):
        values = list({"x" * rnd.randrange(100) + rnd.choice("abcdef") for _ in range(6)})
        flat, sizes = memo.ids(values)
        assert "".join(map(chr, flat)) == "".join(values) and sizes.tolist() == [len(v) for v in values]
    assert len(memo.known) <= 10 and all(len(v) <= token_ids.LONGEST for v in memo.known)


def test_segments_agree_with_whole_texts():
    tokenizers = alignment.Tokenizers(BYTE, PIECE)
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    for t in texts():
        x = alignment.align(tokenizers, pa.array([t], pa.string()))
        if len(x.a):
            assert x.a.tolist() == a.encode(" " + t, add_special_tokens=False).ids and x.b.tolist() == tokenizers.b.encode(t)
