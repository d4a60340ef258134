from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartlens.llm import packing, tokenfiles
from cartlens.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, encoder, vocabulary
from cartlens.runtime import scratch_folder
from tests.llm.brute import SCHEMA, clash, corpus, crc

ODD = ["", " ", "  a  b ", "don't we'll I'M it's 's''s", "naïve Ünïcode ß ÿ × ÷ ª º µ", "ﬁ ½ ² x", "a b", "日本語 text",
       "x\x0by\x1cz", "\n\n a\n\tb  \n", "<|endoftext|> <|startoftext|>", "İstanbul É É", "a1b22c333 !!?? '' 's",
       "soft­hyphen ¡hola! «x» ¿y? ¼ ³", "`'tis' 'll'd", "\r\n x", "\n \n", "a \n b\n  c", "Kſ", "é"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
@pytest.mark.parametrize("cache", [2_000_000, 3])
def test_ids_equal_the_library(name, cache):
    e = Encoder(vocabulary(name), cache)
    texts = ODD + [t or "" for _, t, *_ in corpus()]
    for _ in range(2):
        for at in range(0, len(texts), 7):
            some = texts[at:at + 7]
            assert [i.tolist() for i in e.encode(some, 1)] == [[*e.whole(t), 1] for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z'stre9.,!\n\t é ß<|²¼ "), max_size=30), max_size=4))
def test_any_text(texts):
    for name in (BYTE_BPE, WORD_BPE):
        e = encoder(vocabulary(name))
        assert [i.tolist() for i in e.encode(texts)] == [e.whole(t) for t in texts]


@pytest.mark.parametrize("parts, length", [(4, 2048), (1, 5), (9, 64)])
def test_token_files_round_trip(spark, tmp_path, parts, length):
    rows = corpus()
    df = clash(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    manifest = tokenfiles.write_token_files(df, f"file://{tmp_path}/out", length=length, partitions=parts)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(spark, manifest).collect()}
    e, start, want = encoder(vocabulary(WORD_BPE)), 0, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*e.whole(t or ""), 1]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want
    assert not list((tmp_path / "out").glob("*.tmp"))


def test_file_format(spark, tmp_path):
    """Equal-length rows, full batches, a mask that covers just the ids, and views of the file."""
    import numpy as np
    import pyarrow as pa
    rows = [(i, "word " * 300, None, None, None) for i in range(50)]
    manifest = tokenfiles.write_token_files(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), length=16, partitions=1).first()
    reader = pa.ipc.open_file(pa.memory_map(manifest.file))
    assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 16)
    batches = [reader.get_batch(k) for k in range(reader.num_record_batches)]
    assert len(batches) > 2 and {b.num_rows for b in batches[:-1]} == {tokenfiles.BATCH_SEQUENCES}
    mask = np.concatenate([b.column("mask").values.to_numpy(zero_copy_only=False) for b in batches])
    assert mask.sum() == manifest.n_tokens == mask.argmin() + (mask.all() * len(mask)) and len(mask) - mask.sum() < 16
    tokens = tokenfiles.TokenFile(manifest.file)
    assert not tokens.document(3, 10).flags.owndata
    assert tokens.document(4000, 5000).tolist() == np.concatenate([tokens.ids(k) for k in range(len(batches))])[4000:9000].tolist()


def test_token_files_nulls_and_repeats(spark, tmp_path):
    rows = [(None, "b"), (4, "x y"), (4, "x y"), (4, None)]
    manifest = tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "o"), partitions=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfiles.read_token_files(spark, manifest).collect())
    assert got[0] == (0, None, 2) and len(got) == 4
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and sum(g[2] == 1 for g in got) == 1


def test_token_files_empty_table(spark, tmp_path):
    manifest = tokenfiles.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "o"))
    assert manifest.collect() == [] and tokenfiles.read_token_files(spark, manifest).collect() == []


def pieces_are_whole(got, texts, window):
    """Every id in one piece, sequences without gaps; texts: ids by document."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[i]) and r.length > 0
            assert r.ids_crc32 == crc(texts[i][at:at + r.length])
            at += r.length
        assert at == len(texts[i])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(len(t) for t in texts.values()) / (window * len(by_seq))


@pytest.mark.parametrize("window, how", [(2048, {}), (64, {"region_nodes": 10}), (100, {"region_nodes": 1, "members": 2}), (7, {"members": None})])
def test_packing_is_whole(spark, window, how):
    rows = corpus()
    got = packing.pack(clash(spark.createDataFrame(rows, SCHEMA)).repartition(3), window=window, sketch_bits=12, **how).collect()
    e = encoder(vocabulary(BYTE_BPE))
    full = pieces_are_whole(got, {i: [*e.whole(t or ""), 1] for i, t, *_ in rows}, window)
    assert full > 0.97


def words_by_ids(text):
    """The words of a text as tuples of ids, cut where an id begins with a space or follows white space."""
    e, out = encoder(vocabulary(BYTE_BPE)), []
    blank = lambda i: not e.tokenizer.decode([i]).strip() and e.tokenizer.decode([i]) != ""
    for i in e.whole(text):
        if not out or e.tokenizer.decode([i])[:1].isspace() or blank(out[-1][-1]):
            out.append((i,))
        else:
            out[-1] += (i,)
    return out


def plain_scores(texts, query_terms):
    """For each text the scores of all others by the textbook sum over its
    heaviest words; nothing for words of equal weight at the cut, which a hash decides."""
    import math
    counts = [Counter(words_by_ids(t)) for t in texts]
    n, mean = len(texts), sum(c.total() for c in counts) / len(texts)
    df = Counter(w for c in counts for w in c)

    def weight(c, w):
        tf, size = c[w], c.total()
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) if tf else 0.0

    out = []
    for i, c in enumerate(counts):
        ranked = sorted((-weight(c, w), w) for w in c if df[w] > 1)
        if len(ranked) > query_terms and abs(ranked[query_terms - 1][0] - ranked[query_terms][0]) < 1e-4:
            out.append(None)
            continue
        out.append([sum(weight(d, w) for _, w in ranked[:query_terms]) if j != i else 0.0 for j, d in enumerate(counts)])
    return out


def found_lists(spark, texts, query_terms, members, k, parts, bits=20):
    """Node of each text, and the lists of ``nearest``, by node."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    folder, path = scratch_folder(spark, "test"), vocabulary(BYTE_BPE)
    packing.encode_documents(df, "doc_id", "text", path, 1, bits).write.parquet(folder)
    table = spark.read.parquet(folder)
    n, words = table.selectExpr("count(key)", "sum(words)").first()
    lists = packing.nearest(table, path, "<u2", n, words, query_terms, 0.01, members, k, bits)
    nodes = {r.doc_id: r.node for r in table.where("key is not null").collect()}
    return nodes, {r.node: np.frombuffer(r.near, np.int64).tolist() for r in lists.collect()}


def zipf_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i:03d}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    return [" ".join(rng.choice(words, rng.integers(4, 40), p=share / share.sum())) for _ in range(n)]


def found_groups(spark, texts, every, parts=3, bits=20):
    """(query, score) of each text as ``grouped`` gives them, the query by its number."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    folder, path = scratch_folder(spark, "test"), vocabulary(BYTE_BPE)
    packing.encode_documents(df, "doc_id", "text", path, 1, bits).write.parquet(f"{folder}/ids")
    table = spark.read.parquet(f"{folder}/ids")
    n, words = table.selectExpr("count(key)", "sum(words)").first()
    sketch = spark.sparkContext.broadcast(packing.sketch_of(table, bits))
    rows = packing.grouped(table.where("key is not null"), path, "<u2", sketch, n, words / n, every, 8, folder).collect()
    number = {r.node: r.doc_id for r in rows}
    assert len(rows) == len(texts)
    return {r.doc_id: (number.get(r.query), r.score) for r in rows}


def test_every_text_goes_to_its_best_query(spark, monkeypatch):
    """Against the textbook sum: no list of a word and no list of candidates is cut, whatever the blocks of the index."""
    texts = zipf_texts(300)
    got = found_groups(spark, texts, 10)
    scores, checked = plain_scores(texts, 8), 0
    asking = [i for i in range(0, 300, 10) if scores[i] is not None]
    for j, (query, score) in got.items():
        if j % 10 and max(scores[i][j] for i in asking) > 0:
            assert score > max(scores[i][j] for i in asking) - 3e-3
            if query in asking:
                assert abs(scores[query][j] - score) < 3e-3
                checked += 1
    assert checked > 100
    monkeypatch.setattr(packing, "INDEX_WORDS", 40)
    assert found_groups(spark, texts, 10, parts=5) == got


def test_texts_no_query_reaches_go_where_their_best_text_goes(spark):
    topics = ["alpha beta gamma", "river boat water", "engine wheel brake"]
    texts = [f"{topics[i % 3]} n{i}" for i in range(90)] + ["river flour sugar", "flour sugar butter", "nothing shared"]
    got = found_groups(spark, texts, 51)  # queries 0 and 51: topic 0 only
    assert {got[i][0] for i in range(0, 90, 3)} <= {0, 51}
    assert len({got[i][0] for i in range(1, 90, 3)}) == len({got[i][0] for i in range(2, 90, 3)}) == 1
    assert got[90][0] == got[91][0] is not None and got[92] == (None, None)


def test_a_text_without_partner_by_its_heaviest_words_asks_with_more(spark):
    """Cells that hold several words make words of one text look shared; what is shared is found all the same."""
    own = lambda k: " ".join(f"{k}{c}{c}{c}" for c in "abcdefghijkl" for _ in range(4))
    texts = [f"{own('q')} whale", *[f"{own(chr(97 + i))} word{i}" for i in range(5)], f"{own('z')} whale"]
    got = found_groups(spark, texts, 100, bits=4)
    assert got[0][0] is not None and got[0][0] == got[6][0]


def test_words_are_cut_by_ids():
    e = encoder(vocabulary(BYTE_BPE))
    texts = ["the cat  the\tcat\nthe cat, strange", "", "one", " the cat"]
    hashes, owner = e.word_hashes([np.array(e.whole(t), np.uint16) for t in texts])
    want = [(i, w) for i, t in enumerate(texts) for w in words_by_ids(t)]
    assert owner.tolist() == [i for i, _ in want]
    by_word = {}
    for (_, w), h in zip(want, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    o, h, tf, sizes = packing.batch_terms(e, [np.array(e.whole(t), np.uint16) for t in texts])
    assert sizes.tolist() == [sum(i == j for i, _ in want) for j in range(4)]
    assert sorted(zip(o.tolist(), tf.tolist())) == sorted((i, n) for (i, _), n in Counter(want).items())


def test_lists_equal_brute_force_over_the_whole_corpus(spark, monkeypatch):
    """With all members and no stop words, each list has the best scores of the textbook sum over all documents."""
    monkeypatch.setattr(packing, "FEW", 1000)
    texts, k = zipf_texts(150), 6
    nodes, got = found_lists(spark, texts, 8, None, k, 3)
    text_of, checked = {node: i for i, node in nodes.items()}, 0
    for i, scores in enumerate(plain_scores(texts, 8)):
        if scores is not None:
            found = [text_of[o] for o in got.get(nodes[i], [])]
            best = [s for s in sorted(scores, reverse=True)[:k] if s > 0]
            assert i not in found and len(found) == len(best)
            assert np.allclose([scores[j] for j in found], best, atol=3e-3)
            checked += 1
    assert checked > 60


def test_lists_do_not_depend_on_partitions(spark):
    texts = zipf_texts(60)
    assert found_lists(spark, texts, 8, 4, 6, 1) == found_lists(spark, texts, 8, 4, 6, 5)


def test_members_bound_the_pairs_and_copies_find_each_other(spark):
    """A group of copies larger than ``members``: full lists of copies, not the same few for all."""
    texts = ["one text that many documents hold word for word"] * 90 + zipf_texts(40)
    nodes, got = found_lists(spark, texts, 8, 5, 5, 3)
    copies = {nodes[i] for i in range(90)}
    listed = Counter(o for i in range(90) for o in got[nodes[i]])
    assert all(set(got[nodes[i]]) <= copies and len(got[nodes[i]]) == 5 for i in range(90))
    assert len(listed) == 90 and max(listed.values()) == 5


def test_split_words_still_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPLIT", 10)
    nodes, got = found_lists(spark, ["same words again"] * 60, 8, None, 4, 2)
    assert all(got[nodes[i]] for i in range(60))


def test_neighbours_share_a_window(spark):
    """Texts on one subject are packed together although their ids are far apart."""
    topics = ["alpha beta gamma delta", "river boat water stream", "engine wheel brake clutch", "flour sugar butter oven"]
    rows = [(i, " ".join([topics[i % 4]] * 5) + f" {i}", None, None, None) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), window=256).collect()
    topic = {}
    for r in got:
        topic.setdefault(r.sequence_id, []).append(r.doc_id % 4)
    same = sum(max(t.count(k) for k in range(4)) for t in topic.values()) / sum(map(len, topic.values()))
    assert same > 0.8


def test_packing_nulls_repeats_and_empty(spark):
    rows = [(None, "a b"), (2, None), (2, "c"), (2, "c")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.offset for r in got)[0] == 0
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_of_one_node_lie_one_after_the_other(spark):
    rows = [(1, "a b c d")] * 7 + [(2, "a b x")] + [(None, "a")] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=16, sketch_bits=10).collect()
    at = sorted((r.sequence_id * 16 + r.offset, r.length, r.doc_id) for r in got)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(at, at[1:])) and at[0][0] == 0
    assert sum(1 for x, y in zip(at, at[1:]) if x[2] != y[2]) == 2


def test_seeds_take_their_best_unused_neighbours():
    near = [np.array(x, np.int64) for x in ([3, 1], [0], [4, 0], [0, 4], [2])]
    # 0, then its neighbours 3 and 1; 1 runs into the next window and has none left, so 2 and its neighbour 4 follow
    at, missed = packing.places(np.array([4, 5, 3, 4, 2]), near, 10)
    assert at.tolist() == [0, 8, 13, 4, 16] and missed == 1
    # a seed without neighbours goes on with those of the documents placed since, the last one's first
    near = [np.array(x, np.int64) for x in ([1], [2], [], [], [1])]
    at, missed = packing.places(np.array([1, 1, 1, 1, 1]), near, 100, 7)
    assert at.tolist() == [7, 8, 9, 10, 11] and missed == 2


def test_regions_keep_best_neighbours_together(spark):
    texts = [f"topic{i % 40} subject{i % 40} theme{i % 40} number{i}" for i in range(400)]
    nodes, lists = found_lists(spark, texts, 8, 64, 8, 4)
    table = spark.createDataFrame([(v, 5) for v in nodes.values()], "node long, size long")
    near = spark.createDataFrame([(v, n[0], bytearray(np.array(n, np.int64).tobytes())) for v, n in lists.items()], "node long, best long, near binary")
    held, regions = packing.regions_of(table, near, 400, 50, scratch_folder(spark, "test"))
    region = {r.node: r.region for r in held.collect()}
    assert regions == 8 and len(region) == 400
    together = sum(region[v] == region[n[0]] for v, n in lists.items()) / len(lists)
    assert together > 0.9 and max(Counter(region.values()).values()) <= 150


PLAIN = "ab Z'stre9.,!\n\t\r évlmd«µ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(PLAIN), max_size=40), min_size=1, max_size=5))
def test_cuts_are_those_of_the_pattern(texts):
    from cartlens.llm.tokens import _SPLIT, byte_cuts
    codes = [t.encode("latin-1") for t in texts]
    begins = np.cumsum([0, *map(len, codes)])
    got = byte_cuts(np.frombuffer(b"".join(codes), np.uint8), np.array([b for b, c in zip(begins, codes) if c], np.int64)) if any(codes) else np.zeros(0)
    want = [b + m.start() for b, t in zip(begins, texts) for m in _SPLIT["byte"].finditer(t)]
    assert got.tolist() == want


@pytest.mark.parametrize("cache", [1_000_000, 40])
def test_pieces_are_cut_and_found_for_all_texts_at_once(monkeypatch, cache):
    """No text is split by the pattern one by one, and pieces up to a length are not looked up one by one."""
    from cartlens.llm import tokens

    class Refused:
        def findall(self, text):
            raise AssertionError("a text was split by itself")

    monkeypatch.setitem(tokens._SPLIT, "byte", Refused())
    e = Encoder(vocabulary(BYTE_BPE), cache)
    texts = ["", "one two  three\n four's", "", "é" * 16 + " " + "x" * 16, "y" * 17 + " " + "=" * 300, *(f"w{i} v{i % 7}" for i in range(300)), " " * 40]
    for _ in range(2):
        for some in (texts, texts[:3], [""], texts[::-1]):
            assert [i.tolist() for i in e.encode(some, 1)] == [[*e.whole(t), 1] for t in some]
            assert [i.tolist() for i in e.encode(some)] == [e.whole(t) for t in some]
    assert all(len(p) > tokens.LONGEST for p in e.cache)


def test_pieces_with_the_same_slot_are_told_apart():
    from cartlens.llm.tokens import Pieces
    rng, p = np.random.default_rng(3), Pieces(bits=2)
    keys = np.unique(rng.integers(1, 60, (500, 2), dtype=np.uint64), axis=0)
    for at in range(0, len(keys), 37):
        low, high = keys[at:at + 37, 0], keys[at:at + 37, 1]
        assert (p.find(low, high) == -1).all()
        p.add(low, high, [np.arange(a, a + b % 5, dtype=np.uint32).tobytes() for a, b in zip(low.tolist(), high.tolist())])
    want = [np.arange(a, a + b % 5, dtype=np.uint32).tobytes() for a, b in keys.tolist()]
    assert p.ids_at(p.find(keys[:, 0], keys[:, 1])) == want and p.size == len(keys)


def test_filtered_words_are_those_of_the_index():
    """Words that no query asks for may be left out of a search; a text's number of words stays."""
    e = encoder(vocabulary(BYTE_BPE))
    texts = [np.array(e.whole(t), np.uint16) for t in ("a b c a", "", "d e f " * 9, "x y a")]
    owner, hashes, tf, sizes = packing.batch_terms(e, texts)
    words = np.unique(hashes)[::3]
    got = packing.batch_terms(e, texts, packing.marks(words))
    assert got[3].tolist() == sizes.tolist()
    some, kept = np.isin(hashes, words), np.isin(got[1], words)
    assert [c[some].tolist() for c in (owner, hashes, tf)] == [c[kept].tolist() for c in got[:3]]


def test_documents_no_query_reaches_are_not_read_again_for_their_words(spark, monkeypatch):
    read, plain = [], packing.asked_words
    monkeypatch.setattr(packing, "asked_words", lambda *a: read.append(a) or plain(*a))
    rows = [(i, f"only{i % 5} other{i % 5} of{i % 5}") for i in range(1, 41)] + [(0, "nothing else")] * 2
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64).collect()
    assert sum(r.length for r in got) == sum(len(encoder(vocabulary(BYTE_BPE)).whole(t)) + 1 for _, t in rows)
    assert len(read) == 1
