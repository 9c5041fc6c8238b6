import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from check_oracle import compare, connect
from conftest import EDGES
from dyadspark.llm import chat_format as cf, piece_codec as pc, queries, toxicity as tx
from pyspark.sql import functions as F

PATH = public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def codec():
    return pc.Codec(pc.read_pieces(PATH))


@pytest.fixture(scope="module")
def library():
    """The library's own unigram encoder over the same pieces."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def encoded(codec, texts):
    out = []
    for _, ids, at in codec.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def viterbi(text, pieces):
    """Best sum of scores and the pieces of a text, over the whole text at once."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    score = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k in (pc.NORMAL, pc.USER)}
    unknown = min(s for s, _ in score.values()) - pc.UNKNOWN_PENALTY
    by_byte = {p: i for i, (p, _, k) in enumerate(pieces) if k == pc.BYTE}
    longest = max(map(len, score))
    best = [(0.0, None, None)] + [None] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + longest) + 1):
            if text[a:b] in score:
                s, i = score[text[a:b]]
            elif b == a + 1:
                s, i = unknown, None
            else:
                continue
            # whole scores are exact, so the comparison is that of the segments' sums
            if best[b] is None or best[a][0] + s > best[b][0]:
                best[b] = (best[a][0] + s, a, i)
    out, at = [], len(text)
    while at:
        _, a, i = best[at]
        out.append([i] if i is not None else [by_byte[f"<0x{x:02X}>"] for x in text[a:at].encode()])
        at = a
    return [i for x in reversed(out) for i in x]


def test_trie_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), bytes([255, 0, 255])]
    trie = pc.build_trie(keys)

    def get(key):
        s = 0
        for b in key:
            t = trie.base[s] + b
            if trie.base[s] == 0 or trie.check[t] != s:
                return -1
            s = t
        return int(trie.value[s])

    assert [get(k) for k in keys] == list(range(len(keys))) and get(b"ac") == get(b"c") == get(bytes([195])) == -1


def test_encoding_equals_viterbi_over_whole_texts(codec, corpus_rows):
    pieces = pc.read_pieces(PATH)
    texts = [t or "" for _, t in EDGES if len(t or "") < 6000] + [t for _, t in corpus_rows if len(t) < 1500][:25]
    texts = [t.replace("▁", " ") for t in texts]
    assert encoded(codec, texts) == [viterbi(t, pieces) for t in texts]


def test_no_sum_is_below_the_library_s(codec, library, corpus_rows):
    """The library's segmentation is never better, and for words of known characters nearly always the same."""
    lines = [line for _, t in corpus_rows for line in t.split("\n")][:1500]
    words = sorted({w for line in lines for w in line.split()})
    score = [s for _, s, _ in pc.read_pieces(PATH)]
    same = known = 0
    for text, ids in zip(words + lines, encoded(codec, words + lines)):
        if not codec.is_byte[np.array(ids, dtype=int)].any():
            other = library.encode(text)
            assert sum(score[i] for i in ids) >= sum(score[i] for i in other)
            if " " not in text:
                known, same = known + 1, same + (ids == other)
    assert known > 3000 and same > 0.99 * known


def test_decoding_is_a_round_trip(codec, library, corpus_rows):
    texts = [t or "" for _, t in EDGES] + [t for _, t in corpus_rows]
    for t, ids in zip(texts, encoded(codec, texts)):
        assert codec.decode(np.array(ids, dtype=np.int64)) == t.replace("▁", " ")
        assert library.decode(ids) == t.replace("▁", " ")
    assert codec.decode(np.array([codec.byte_ids[0xFF]])) == "�"


def test_small_cache_changes_nothing(codec, corpus_rows, monkeypatch):
    texts = [t for _, t in corpus_rows]
    want = encoded(codec, texts)
    monkeypatch.setattr(pc, "CACHED", 10)
    assert encoded(codec, texts) == want


def test_new_segments_are_solved_in_bounded_runs(codec, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(4_000)) for _ in range(8)] + ["x" * 100_000]
    codec._forget()
    whole, sizes, solve = encoded(codec, texts), [], codec._solve
    monkeypatch.setattr(codec, "_solve", lambda data, lengths: sizes.append((len(data), len(lengths))) or solve(data, lengths))
    codec._forget()
    assert encoded(codec, texts) == whole
    assert all(size <= 1 << 16 or segments == 1 for size, segments in sizes) and sum(size for size, _ in sizes) > 400_000


def test_codec_query(spark, folder, corpus_rows, codec):
    got = {r.doc_id: r for r in queries.QUERIES["op8_piece_codec"](spark, folder).collect()}
    for (d, t), ids in zip(corpus_rows, encoded(codec, [t for _, t in corpus_rows])):
        assert got[d].n_pieces == len(ids) and got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[d].n_byte_pieces == codec.is_byte[ids].sum()


def test_codec_of_edge_cases(edges, clashing, no_docs):
    for docs in (edges, clashing):
        rows = pc.encode(docs, PATH).collect()
        assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(d), (t or "").replace("▁", " ")) for d, t in EDGES)
        assert all(len(r.ids) == r.n_pieces for r in rows)
    assert pc.encode(no_docs, PATH).collect() == []


TURNS = "conv_id long, turn int, role string, text string, size string, block string"


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\<|", "<\\|", "<\\\\|", "<|im_end|>\n<|im_start|>a\n", "\\\\<<||", "<\n|", "<\\n|"])
def test_escapes_are_reversible(spark, text):
    t = F.lit(text)
    row = spark.range(1).select(
        cf.escape(t).alias("a"), cf.unescape(cf.escape(t)).alias("b"), cf.escape_role(t).alias("c"),
        cf.unescape_role(cf.escape_role(t)).alias("d")).first()
    assert row.b == row.d == text and "<|" not in row.a + row.c and "\n" not in row.c


def test_chat_query_equals_its_sql(spark, folder):
    name = "op9_chat_format"
    assert compare(queries.QUERIES[name](spark, folder), connect(folder).sql(queries.CHECKS[name])) == ""


def expected_chat(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for c, _, role, text in rows:
        turns, loss = out.get(c, ("", ""))
        out[c] = (turns + f"{role or ''}\n{text or ''}\n", loss + (text or "" if role == "assistant" else ""))
    return out


def test_windows_of_random_conversations(spark):
    rng = random.Random(2)
    bits = ["word", "<|im_end|>", "\\", "<|", "|>", "<\\|", "é😀", "\n", "a b c"]
    rows = []
    for c in [*range(12), None]:
        for t in range(rng.randrange(1, 60)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool\nx", None, "system"])
            text = None if rng.random() < 0.05 else " ".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 200])))
            rows.append((c, rng.choice([t, t, None]), role, text))
    rows += rows[:20]
    turns = turn_table(spark, rows)
    for options in ({}, {"budget": 200, "history": 60, "system_room": 40}, {"budget": 300, "block_turns": 7, "history": 0, "system_room": 0}):
        windows = cf.chat_windows(turns, **options).cache()
        read = {r.conv_id: (r.turns, r.loss, r.n_turns) for r in cf.read_back(windows).collect()}
        want = expected_chat(rows)
        assert {c: v[:2] for c, v in read.items()} == want
        assert sum(v[2] for v in read.values()) == len(rows)
        budget = options.get("budget", 1024)
        for w in windows.collect():
            assert w.over_budget == (w.n_tokens > budget) and w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>\n")
            own = w.formatted.count("<|im_start|>") - w.n_repeated
            assert own >= 1 and (not w.over_budget or own == 1 or w.n_repeated)


def test_system_turn_opens_every_window_and_history_repeats(spark):
    rows = [(1, 0, "system", "rules of the house")]
    rows += [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * 20) for t in range(1, 30)]
    windows = cf.chat_windows(turn_table(spark, rows), budget=200, history=40, system_room=20).orderBy("block", "window").collect()
    assert len(windows) > 3 and not any(w.over_budget for w in windows)
    for before, w in zip(windows, windows[1:]):
        turns = w.formatted.split("<|im_start|>")[1:]
        assert turns[0] == "system\nrules of the house<|im_end|>\n" and w.n_repeated == 2
        assert turns[1] == before.formatted.split("<|im_start|>")[-1]


def test_chat_of_edge_cases(spark):
    assert cf.chat_windows(turn_table(spark, [])).collect() == []
    one = cf.chat_windows(turn_table(spark, [(1, 0, "assistant", "word " * 5000)])).collect()
    assert len(one) == 1 and one[0].over_budget and one[0].loss[0].length == 25000
    with pytest.raises(ValueError):
        cf.chat_windows(turn_table(spark, []), budget=10)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("abcdefgh") + rng.choice(["lor", "men", "tis", "qua"]) + rng.choice("aeiou") for _ in range(rng.randrange(5, 400))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "numskull", "vermintide"]) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark, make, labelled):
    rows, labels = labelled
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.toxicity(make(rows), table).collect()
    truth = dict(labels)
    assert {r.doc_id: r.held_out for r in got} == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in truth}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    kept = {r.doc_id for r in tx.drop_toxic(make(rows), table).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_never_used(spark, make, labelled):
    rows, labels = labelled
    other = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in labels]
    scores = [
        {r.doc_id: r.score for r in tx.toxicity(make(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, other)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_fitting_sample_is_bounded(spark, make, labelled):
    rows, labels = labelled
    picked = tx.fitting_rows(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), 50)
    assert [r["count"] for r in picked.groupBy("toxic").count().collect()] == [50, 50]


def test_toxicity_of_edge_cases(spark, edges, clashing, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (99, 1), (6, 1), (6, 0), (8, 0)], "doc_id long, toxic int")
    for docs in (edges, clashing):
        rows = tx.toxicity(docs, none).collect()
        assert len(rows) == len(EDGES) and {r.score for r in rows} == {0.5}
        assert len(tx.toxicity(docs, odd).collect()) == len(EDGES)
        assert tx.drop_toxic(docs, none).columns == docs.columns
    assert tx.toxicity(no_docs, none).collect() == []


def test_buckets_are_the_ngrams_of_each_text():
    texts = ["Ab\n cd", "", "xyz", "é" * 9]
    got = [set() for _ in texts]
    for rows, found in tx.buckets(texts, 20):
        for r, b in zip(rows.tolist(), found.tolist()):
            got[r].add(b)
    alone = [set(int(b) for _, f in tx.buckets([t], 20) for b in f) for t in texts]
    assert got == alone and len(got[0]) == 4 + 3 + 2 and not got[1]


def test_texts_reach_toxicity_in_small_batches(spark):
    session = spark.newSession()
    docs = session.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))
    none = session.createDataFrame([], "doc_id long, toxic int")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    kept = tx.drop_toxic(docs, none)
    largest = max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
    assert 4 << 20 < largest < 9 << 20
    assert kept.count() == 4000
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    assert tx.drop_toxic(docs, none).count() == 4000
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_runs_hold_a_bounded_part_of_the_texts():
    texts = [None, "", "é" * 1000, "x" * 600_000, *["word " * 200] * 1000, "", None]
    column = pa.array(["before", *texts]).slice(1)
    runs = list(tx._runs(column))
    assert [t for _, run in runs for t in run] == [t or "" for t in texts]
    assert [first for first, _ in runs] == np.cumsum([0, *(len(run) for _, run in runs[:-1])]).tolist()
    assert len(runs) > 4 and all(len(run) == 1 or sum(map(len, run)) <= tx._RUN_BYTES for _, run in runs)
