import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as spark_functions

from tidewright.llm import chat, decontaminate, exact_dedup, jaccard_join, langid, masked_lm, pieces, sstable, toxicity, warc

DOCS = "doc_id bigint, text string, n bigint, file string, class string"
WORDS = [f"w{k}" for k in range(400)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0, "f", "c") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_exact_dedup_keeps_the_largest_id_even_if_digests_collide(spark):
    df = frame(spark, ["Aa", "aA", "Éa", "éa", None, "", "aa", "aa"], [1, 2, 3, 4, 5, 6, None, 2])
    for digest in (exact_dedup.sha256_hex, lambda t: exact_dedup.sha256_hex(exact_dedup.F.substring(t, 1, 0))):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df, digest=digest).collect())
        assert got == [(-1, 2, 4), (1, 2, 4), (2, 2, 4), (2, 2, 4), (3, 3, 1), (4, 4, 1), (5, 6, 2), (6, 6, 2)]
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6]
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_dedup_state_is_kept_between_arrivals(spark, tmp_path):
    schema = "digest string, doc_id bigint, file string, row bigint"
    folder, state = f"file://{tmp_path}/digests", f"file://{tmp_path}/state"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return sorted((r.digest, r.top.doc_id, r.size) for r in exact_dedup.digest_state(spark, folder, spark.createDataFrame([], schema).schema, state, 1).collect())

    assert arrive(("a", 3, "f", 0), ("b", 4, "f", 1)) == [("a", 3, 1), ("b", 4, 1)]
    assert arrive(("a", 9, "g", 0), ("c", 1, "g", 1)) == [("a", 9, 2), ("b", 4, 1), ("c", 1, 1)]  # a's hit comes from the first arrival
    assert arrive(("a", 2, "h", 0)) == [("a", 9, 3), ("b", 4, 1), ("c", 1, 1)]


def test_a_column_named_metadata_is_kept(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and then runs away from it all"
    df = frame(spark, ["a b", "A b", base, base + " again", None]).withColumn("_metadata", spark_functions.lit("mine"))
    for docs in (df, spark.read.parquet(stored(df, tmp_path))):
        left = exact_dedup.deduplicate(docs)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4]
        left = jaccard_join.one_of_each(docs, n=3, percent=80)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.where("_metadata = 'mine'").collect()) == [0, 2, 4]


def stored(df, tmp_path):
    path = f"{tmp_path}/docs.parquet"
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("chunk", [512, 3])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "One", "one two", "a b c", "a b c a b c"]
    for _ in range(6):
        base = text(rng, rng.randint(60, 200)).split()
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [text(rng, 80) for _ in range(10)]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 90 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(frame(spark, texts)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert len(set(label)) < len(texts) - 10
    if chunk == 512:
        assert sorted(r.doc_id for r in jaccard_join.one_of_each(frame(spark, texts)).collect()) == sorted(set(label))


def test_decontamination_finds_passages_and_leaves_others(spark):
    rng = random.Random(5)
    items = [text(rng, n) for n in (3, 20, 40, 60)]
    edited = items[3].split()
    edited[30] = "other"
    docs = [text(rng, 100) + " " + items[2].upper() + ". " + text(rng, 100), " ".join(edited), items[0], text(rng, 300), None, "", items[1]]
    bench = spark.createDataFrame(list(enumerate([*items, None])), "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 3)) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert {k: v for k, v in found.items() if k[1]} == {(0, 2): (100, 1.0), (1, 3): (0, round(51 / 61, 3)), (6, 1): (0, 1.0)} and (2, 0) in found
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame(spark, docs), bench.where("item_id > 0")).collect()) == [2, 3, 4, 5]


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2, (30, decontaminate.BITS)).astype(np.uint8)
    queries = prints.copy()
    for k, q in enumerate(queries):
        q[rng.choice(decontaminate.BITS, k, replace=False)] ^= 1
    for radius in (0, 1, 17, 30, 48, 77, 128):
        want = {(i, j, int((p != q).sum())) for i, q in enumerate(queries) for j, p in enumerate(prints) if (p != q).sum() <= radius}
        found = [t for part in decontaminate.HammingIndex(prints, radius).search(queries) for t in zip(*(x.tolist() for x in part))]
        assert set(found) == want and len(found) == len(want)


def test_streaming_search_equals_a_whole_lattice():
    p = pieces.load(pieces.default_model())
    rng = random.Random(2)
    for s in ["x" * 300, "".join(rng.choice("abcdeéxß漢") for _ in range(500)), "the  quick\n▁brown ￾ fox", " ", "a"]:
        assert p.decode(p.encode(s)) == s
        marked = " ".join(s.split("￾")).replace("▁", "").replace(" ", pieces.SPACE)
        best = [(0.0, ())] + [None] * len(marked)
        for i in range(len(marked)):
            hits = [(j, p.scores[marked[i:j]]) for j in range(i + 1, min(i + p.longest, len(marked)) + 1) if marked[i:j] in p.scores]
            if not any(j == i + 1 for j, _ in hits):
                hits.insert(0, (i + 1, (p.unknown, -1)))
            for j, (score, piece) in hits:
                total = best[i][0] + score
                if best[j] is None or total > best[j][0]:
                    best[j] = (total, (best[i][1], i, piece))
        ids, node, end = [], best[-1][1], len(marked)
        while node:
            ids[:0] = [node[2]] if node[2] >= 0 else [p.byte_id[b] for b in marked[node[1] : end].encode()]
            node, end = node[0], node[1]
        assert list(p.search(marked.replace(pieces.SPACE, " "))) == ids


def test_piece_batches_equal_the_search_for_one_text(monkeypatch):
    p = pieces.load(pieces.default_model())
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc é漢🙂▁\n\t ") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["", " ", "  a", "y" * 300, " " * 100, "\ufffe"]
    raw = [t.encode() for t in texts]
    ids, begins = p.encode_all(raw)
    for k, t in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == (list(p.search(" " + t)) if t else [])
    assert list(p.decode_all(ids, begins)) == raw
    monkeypatch.setattr(p, "stretches", False)  # as if pieces crossed white space
    again, at = p.encode_all(raw)
    assert (again == ids).all() and (at == begins).all()


@pytest.mark.parametrize("pattern", [" ", "ab", "x \n", "漢"])
def test_piece_search_is_linear_and_exact_on_long_texts(pattern):
    import time

    p = pieces.load(pieces.default_model())
    took = []
    for n in (20_000, 100_000):
        t = (pattern * n)[:n]
        begin = time.process_time()
        ids = p.encode(t)
        took.append(time.process_time() - begin)
        assert p.decode(ids) == t
    assert took[1] < 12 * took[0] + 1


def test_only_small_tables_are_broadcast(spark):
    from tidewright.llm import common

    df = common.stage(spark.range(1000), "t")
    hint = lambda x: "hint" in x._jdf.queryExecution().logical().toString().lower()
    assert hint(common.bounded(df)) and not hint(common.bounded(df, rows=999)) and not hint(common.bounded(df, size=100))
    left = common.drop_rows(spark.range(1200), df, ["id"])
    assert sorted(r.id for r in left.collect()) == list(range(1000, 1200))


def test_slices_keep_every_row():
    import pyarrow as pa

    from tidewright.llm.common import slices

    texts = ["a" * k for k in (0, 70, 5, 100, 3)] + [None, "b" * 20, "b" * 20, "b" * 20, "b" * 20]
    batch = pa.RecordBatch.from_pydict({"text": texts, "id": list(range(10))})
    got = list(slices([batch, batch.slice(0, 0)], size=60))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts and [x for b in got for x in b.column("id").to_pylist()] == list(range(10))
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column("text").to_pylist()) <= 60 for b in got)


def test_portions_keep_every_text():
    texts = [b"a" * k for k in (0, 5, 100, 3, 0, 50, 50)]
    got = list(pieces.portions(texts, 60))
    assert [k for low, high in got for k in range(low, high)] == list(range(7))
    assert all(high - low == 1 or sum(map(len, texts[low:high])) <= 60 for low, high in got)
    assert list(pieces.portions([], 60)) == []


def test_chat_windows_read_back_exactly(spark):
    rows = [(1, 0, "system", "be <b>"), *[(1, k, "assistant" if k % 2 else "user", f"t{k} \\l </turn> " + "w " * 40) for k in range(1, 30)], (2, None, None, None), (None, 1, "assistant", "x>"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(df, budget=200, bucket=8)
    assert made.agg({"n_tokens": "max"}).first()[0] <= 200 and made.where("conv_id = 1").count() > 5
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for cid in (1, 2, 3, None):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == cid]
        want = "".join(f"{a}\n{b}\n" for a, b in mine)
        target = "".join(b for a, b in mine if a == "assistant")
        r = got[cid]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(want.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())


def test_sstable_round_trip_and_lookup():
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File()
    w = sstable.Writer(f, 2)
    ids = [None, -5, 0, 7, 7, 2**40]
    for k, i in enumerate(ids):
        w.add(sstable.key_of(i), np.arange(k * 30_000 % 65_000, dtype="<u2").tobytes())
    w.close()
    r = sstable.Reader(f)
    assert [sstable.id_of(k) for k, _ in r] == ids and len(r.index) > 1
    assert [len(x) for x in r.get(7)] == [90_000 % 65_000, 120_000 % 65_000] and r.get(8) == [] and len(r.get(None)) == 1


def test_shards_equal_the_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.default_tokenizer())
    texts = ["Hello  World's\nend", None, "", "x y z é <|endoftext|> 42", "ΣΑΣ straße"]
    got = {r.doc_id: r for r in sstable.read_shards(sstable.write_shards(frame(spark, texts), f"file://{tmp_path}/s", 2)).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_equal_the_library_on_odd_texts_and_a_small_memory(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "REMEMBERED", 40)
    words, t = sstable.Words(sstable.default_tokenizer()), Tokenizer.from_file(sstable.default_tokenizer())
    rng = random.Random(8)
    odd = ["İ.", "ΣΑΣ,", "e\u0301.", "\u0958.", "\u0958", "don't", "'s", "a'.", "x...", "É!", "3.14", "<|endoftext|>.", "\u0085a", "a\u00a0b", "\u200b.", "ǅ,", "ﬁn;", "\x00", "漢字.", "a\rb"]
    texts = [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choice([*odd, *WORDS, *(w + "." for w in WORDS)]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + odd
    got = list(words.encode_all([x.encode() for x in texts], b""))
    assert [np.frombuffer(g, words.kind).tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_shards_answer_look_ups(spark, tmp_path):
    ids = [None, -3, 5, 5, 900, *range(1000, 1400, 2)]
    made = sstable.write_shards(frame(spark, [f"w{k}" for k in range(len(ids))], ids).repartition(4), f"file://{tmp_path}/s", 2)
    everything = {}
    for i, e in zip(ids, sstable.Words(sstable.default_tokenizer()).encode_all([f"w{k}".encode() for k in range(len(ids))], b"\2\0")):
        everything.setdefault(i, []).append(np.frombuffer(e, "<u2").tolist())
    wanted = spark.createDataFrame([(k,) for k in [None, 5, 5, 1001, 1002, 1398, 7]], "doc_id bigint")
    got = {}
    for r in sstable.look_up(made, wanted).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(everything[k]) for k in (None, 5, 1002, 1398)}
    assert sstable.look_up(made, wanted.limit(0)).count() == 0


def test_warc_round_trip_with_segments(spark, tmp_path):
    big = "é<p>" * 40_000
    pages = [(1, "http://a", "x"), (2, "http://b", big), (0, None, "x"), (3, "http://c", None), (4, "u", ""), (5, "u", big), (None, "u", "x")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/w")).collect()}
    first = {"x": 0, big: 2, "": 3}
    assert got == {i: (len((h or "").encode()), warc.digest_of((h or "").encode()), *(("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))) for i, _, h in pages}
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_warc_revisits_without_their_response_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id bigint, url string, html string")
    made = warc.write_archives(df.repartitionByRange(2, "page_id"), f"file://{tmp_path}/w")
    got = []
    for r in made.collect():
        got += [(x.page_id, x.record_type, x.payload_bytes, x.refers_to, x.payload_digest) for x in warc.read_archives(made.where(spark_functions.col("path") == r.path)).collect()]
    digest = warc.digest_of(b"same")
    assert sorted(got) in ([(1, "response", 4, None, digest), (2, "revisit", None, None, digest)], [(1, "response", 4, None, digest), (2, "revisit", 4, 1, digest)])


def test_language_network_gradients_and_predictions(spark):
    model = langid.fit([b"aaaa bbbb abab" * 9, b"xyxy yyyy xxyx" * 9], ["p", "q"], steps=60)
    df = frame(spark, ["abab abba bbaa", "xyyx xxyy " * 100, None, "", "12 34"])
    got = [(r.lang_pred, r.score) for r in langid.predict(df, model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["p", "q", "und", "und", "und"] and got[0][1] > 0.9 and got[2][1] == 0
    x, y = np.frombuffer(b"abxyabxyaxby", np.uint8).reshape(4, 3).copy(), np.array([0, 1, 0])
    loss, g = model.gradients(x, y)
    for d in (0, 1):
        for at in [(d, 3, 2), (d, 10, 1), (d, 20, 5)]:
            eps = 1e-2
            model.U[at] += eps
            up = model.gradients(x, y)[0]
            model.U[at] -= 2 * eps
            down = model.gradients(x, y)[0]
            model.U[at] += eps
            assert abs((up - down) / (2 * eps) - g["U"][at]) < 2e-2 * max(0.05, abs(g["U"][at]))


def test_toxicity_folds_and_excuses():
    lex = toxicity.Lexicon({toxicity.fold("idiot"): 1.0, " " + toxicity.fold("lowei").strip(): 1.0}, ["idiot proof"], cut=0.01)
    a = lex.automaton()
    hot = [lex.density(t, a) for t in ("you 1D10T", "іdіоt!", "die loweischaft", "ＩＤＩＯＴ")]
    assert min(hot) > 0 and [lex.density(t, a) for t in (None, "", "idiot-proof design", "idiotic", "12")] == [0] * 5
    assert lex.score(hot[0]) > 0.5 > lex.score(0.0)


def test_lm_prefers_its_own_corpus(spark):
    rng = random.Random(1)
    good = ["the cat sat on the mat and the dog ran to the door " * 5 for _ in range(30)]
    odd = [" ".join(rng.sample(good[0].split(), 60)) for _ in range(2)]
    got = {r.doc_id: r for r in masked_lm.score(frame(spark, [*good, *odd, None, " "])).collect()}
    assert min(got[k].mean_log_prob for k in range(30)) > max(got[k].mean_log_prob for k in (30, 31))
    assert (got[32].n_words, got[32].log_prob, got[32].mean_log_prob) == (0, 0.0, None)


def test_lm_tells_rare_words_apart_by_their_counts(spark):
    texts = ["the and of " * 40, *["seen " * 5] * 2, "once"]
    got = {r.doc_id: r for r in masked_lm.score(frame(spark, texts), vocabulary=3).collect()}
    vocabulary, rare = masked_lm.count_words(frame(spark, texts), 3)
    assert vocabulary.rare_mass == 11 and sorted(r.n for r in rare.collect()) == [1, 10]
    assert got[3].n_words == 1 and got[1].mean_log_prob > got[3].mean_log_prob + 1


def small_lm(mass, top=2):
    tree = masked_lm.huffman(np.array(mass), top)
    words = np.arange(len(mass)) * 11
    return masked_lm.Vocabulary(words, np.arange(len(mass)), 0, tree)


def test_lm_predicts_the_word_itself_from_its_sides():
    a, b, x, y = range(4)  # x and y are equally frequent; their sides alone tell them apart
    rng = random.Random(4)
    v, w = small_lm([100, 100, 50, 50]), masked_lm.initial()
    sequence, at = masked_lm.line_up(np.array([k for _ in range(2000) for k in rng.choice([(a, x, a), (b, y, b)])]), np.arange(0, 6001, 3))
    assert (sequence[at] != masked_lm.EDGE).all() and len(sequence) == 6000 + 2 * 2001
    squares = masked_lm.no_squares(w)
    for _ in range(20):
        for k in range(0, len(sequence) - 4, 256):
            masked_lm.train_step(w, squares, sequence[k : k + 260], v.tree)
    score = lambda *rows: masked_lm.log_probabilities(v, w, np.array(rows), np.array([0, len(rows)]))
    assert score(a, x, a)[1] > score(a, y, a)[1] + 1
    assert abs(sum(np.exp(score(a, k, b)[1]) for k in range(4)) - 1) < 1e-5


def test_lm_gradients_equal_differences():
    v, w = small_lm([50, 40, 30, 20, 10, 5, 3]), [x.astype(np.float64) for x in masked_lm.initial()]
    rng = np.random.default_rng(3)
    w[3][:8] = rng.normal(size=(8, masked_lm.HIDDEN))
    rows, begins = rng.integers(0, 7, 40), np.array([0, 25, 25, 40])
    sequence, _ = masked_lm.line_up(rows, begins)
    loss = lambda: -masked_lm.log_probabilities(v, w, rows, begins).sum()
    words, (found, de), dw1, db1, top, others = masked_lm.gradients(w, sequence, v.tree)
    assert words == 40
    du = {k: g for k, g in enumerate(top)} | {int(n): g for nodes, sums in others for n, g in zip(nodes, sums)}
    wanted = [(w[0], (int(r), 3), g[3]) for r, g in zip(found[:4], de)] + [(w[1], (k, 5), dw1[k, 5]) for k in (0, 9, 31)] + [(w[2], (k,), db1[k]) for k in (0, 7)] + [(w[3], (n, 4), g[4]) for n, g in du.items()]
    for table, at, g in wanted:
        kept, eps = table[at], 1e-5
        table[at] = kept + eps
        up = loss()
        table[at] = kept - eps
        down = loss()
        table[at] = kept
        assert abs((up - down) / (2 * eps) - g) < 1e-3 * max(1, abs(g))


def test_lm_words_equal_plain_splitting():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab É\n\t \x0b") for _ in range(rng.randint(0, 60))).encode() for _ in range(80)]
    hashes, which, begins = masked_lm.hashed_words(texts)
    for k, t in enumerate(texts):
        assert hashes[which[begins[k] : begins[k + 1]]].tolist() == [hash(x) for x in t.lower().split()]


def test_lm_trains_on_every_position(spark, monkeypatch):
    staged, stage = {}, masked_lm.stage
    monkeypatch.setattr(masked_lm, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    docs = frame(spark, ["a b c " * 50, "d", None, "e f"]).select("doc_id", "text")
    vocabulary = masked_lm.count_words(docs)[0]
    masked_lm.train(masked_lm.named(docs, vocabulary), vocabulary)
    assert staged["weights"].agg({"seen": "sum"}).first()[0] == 153


def test_decontamination_finds_items_with_repeated_shingles():
    rng = random.Random(9)
    for _ in range(5):
        item = [f"i{k}" for k in range(188)] + ["again"] * 12
        rng.shuffle(item)
        changed = {k for k, w in enumerate(item) if w == "again"} | set(rng.sample([k for k, w in enumerate(item) if w != "again"], 8))
        window = [f"o{k}" if k in changed else w for k, w in enumerate(item)]
        words = ["before"] * 30 + window + ["after"] * 30
        got = decontaminate.Benchmark([(1, " ".join(item))], 1, 0.8).match(" ".join(words))
        assert [(g[0], round(g[4], 6)) for g in got] == [(1, round(180 / 220, 6))]
    for _ in range(100):
        words = decontaminate.word_hashes(" ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 40))))
        item = decontaminate.Counter(decontaminate.word_hashes(" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12)))).tolist())
        width = min(sum(item.values()), len(words))
        want = min((-decontaminate.weighted_similarity(words[s : s + width], item), s) for s in range(len(words) - width + 1))
        at = [p for p, g in enumerate(words.tolist()) if g in item]
        got = decontaminate.best_of(np.arange(len(words) - width + 1), at, words, item, width)
        assert got == (want if want[0] else (0.0, 0))


def test_language_learning_reads_any_part_and_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "fit", lambda texts, labels: (texts, labels))
    rows = [(k, "a" * 4096 + "b" * 40_000, f"l{k % 205}") for k in range(410)]
    texts, labels = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows_each=10)
    assert len(texts) == 410 and len(set(labels)) == 205 and {len(x) for x in texts} == {4096}
    assert sum(x.endswith(b"b") for x in texts) > 350


def test_toxicity_learns_exception_phrases(spark):
    rng = random.Random(7)
    texts = [f"{text(rng, 9)} moron {text(rng, 9)}" for _ in range(200)] + [f"{text(rng, 9)} moron proof {text(rng, 9)}" for _ in range(4)] + [text(rng, 20) for _ in range(196)]
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400)], "doc_id bigint, toxic int")
    lex = toxicity.learn(frame(spark, texts), labels)
    a = lex.automaton()
    assert "moron proof" in lex.exceptions
    assert lex.density("w1 moron proof w2", a) == 0 < lex.density("w1 moron w2", a)


def similar_window(rng, item, threshold=0.8):
    """The item with as many shingles of size 1 replaced as the threshold lets, the heaviest first or at random, by one other or several."""
    n = len(item)
    lost = int(n * (1 - threshold) / (1 + threshold) + 1e-9)
    counts = decontaminate.Counter(item)
    order = sorted(range(n), key=lambda k: (-counts[item[k]], item[k]) if rng.random() < 0.5 else (0, rng.random()))[:lost]
    new = ["new"] if rng.random() < 0.5 else [f"n{k}" for k in range(n)]
    return [rng.choice(new) if k in order else w for k, w in enumerate(item)]


def test_radius_covers_windows_at_the_threshold():
    rng, missed = random.Random(11), 0
    for k in range(1500):
        n = rng.choice((1, 4, 9, 10, 27, 40, 90, 200))
        item = [f"i{j}" if rng.random() < 0.8 else f"i{rng.randrange(3)}" for j in range(n)]
        prints = [decontaminate.fingerprints(decontaminate.gram_hashes(decontaminate.word_hashes(f"{' '.join(x)}"), 1), n) for x in (item, similar_window(rng, item))]
        missed += int((prints[0] != prints[1]).sum()) > decontaminate.radius(list(decontaminate.Counter(item).values()), 0.8)
    assert missed == 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    items = [" ".join(rng.choice(WORDS[:60] if k % 3 else WORDS[:4]) for _ in range(rng.choice((2, 7, 30, 60)))) for k in range(24)] + [None, ""]
    docs = [None, ""]
    for k in range(60):
        words = items[k % 24].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        docs.append(" ".join([*text(rng, rng.randrange(50)).split(), *words, *text(rng, rng.randrange(50)).split()]))
    want = set()
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            words = decontaminate.word_hashes(item)
            if len(words):
                n = min(5, len(words))
                own, grams = decontaminate.gram_hashes(words, n), decontaminate.gram_hashes(decontaminate.word_hashes(t), n)
                width = min(len(own), len(grams))
                found = min(((-decontaminate.weighted_similarity(grams[s : s + width], decontaminate.Counter(own.tolist())), s) for s in range(len(grams) - width + 1)), default=(0, 0))
                if -found[0] >= 0.8:
                    want.add((d, i, found[1], round(-found[0], 6)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for size in (4_000_000, 700):  # one block, several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 6)) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
        assert got == want and len(want) > 30
        left = decontaminate.decontaminate(frame(spark, docs), bench)
        assert left.columns == frame(spark, docs).columns and sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(docs))) - {d for d, *_ in want})
