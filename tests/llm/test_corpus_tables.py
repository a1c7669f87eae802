"""Source divergence, token stores and cross-tokenizer links against plain loops."""

import hashlib
import json
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillgraph.llm import alignment, divergence, token_store
from rillgraph.llm.queries import ORACLES, QUERIES, vocabulary
from tests.conftest import SF, duck, same_rows

WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
NO_ROWS = "doc_id long, text string, lang string, source string, n int, total long, tile int, block int, stripe int"


# 11: source divergence


def brute_audit(rows) -> set:
    """The audit of (text, lang, source) rows by loops over exact integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = divergence_terms(text)
        counts[lang, source].update(own)
        held[lang].update(set(own))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= 10)
        sides = sorted({r[2] for r in rows if r[1] == lang})
        total = Counter()
        for s in sides:
            total.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sides}, share(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sides:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sides if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            out |= {(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)}
    return out


def divergence_terms(text: str) -> list[str]:
    import re

    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)


def audited(df) -> set:
    rows = df.collect()
    out = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("tile, chunk, block, held", [(64, 512, 2048, 200_000), (3, 2, 5, 7)])
def test_audit_matches_loops(spark, odd, documents, monkeypatch, tile, chunk, block, held):
    """Also where tiles, matrices, blocks and what a task holds are tiny: no bound changes a digit."""
    for name, value in (("TILE", tile), ("CHUNK", chunk), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    more = [(k, f"Été dé{k % 3} WORD word_{k % 7} \x7f日本", "x" if k % 2 else None, f"s{k % 9}" if k % 5 else None, 1) for k in range(60)]
    docs = odd.unionByName(documents, allowMissingColumns=True).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    want = brute_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert audited(divergence.audit(docs)) == want and {r[2] for r in want} == {"pair", "term"}


def test_groups_without_kept_terms_give_pairs_of_zero(spark):
    docs = spark.createDataFrame([(1, "one", "a", "s"), (2, None, "a", "t"), (3, "", "b", "u")], "doc_id long, text string, lang string, source string")
    assert audited(divergence.audit(docs)) == {("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)}
    assert divergence.audit(spark.createDataFrame([], NO_ROWS)).collect() == []


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([[0, 10**12, 8 * 10**15 - 7]]), np.array([[8 * 10**15 + 11]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * (int(c) + 2) // int(total[0, 0]) for c in counts[0]]]


def test_a_long_text_is_split_between_terms(monkeypatch):
    text = "Ab cd-EF " * 50 + "z" * 40 + " é" * 30
    want = [t.encode() for t in divergence_terms(text)]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for some in divergence.words(text) for t in some] == want


# 12: token store


def library_ids(texts) -> list[np.ndarray]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(WORDS))
    return [np.array([*e.ids, 1], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_store_holds_the_librarys_ids(spark, odd, documents, tmp_path):
    """Ids, starts in the order of doc_id with nulls first, and the option to read some documents."""
    docs = odd.unionByName(documents.withColumn("doc_id", documents.doc_id + 100), allowMissingColumns=True)
    folder = str(tmp_path / "store")
    token_store.write(docs, vocabulary(WORDS), folder)
    rows = docs.select("doc_id", "text").collect()
    ids = library_ids([r["text"] for r in rows])
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, zlib.crc32(ids[k].tobytes())))
    want, start = [], 0
    for k in order:
        want.append((rows[k]["doc_id"], start, len(ids[k]), ids[k].tolist()))
        start += len(ids[k])
    got = sorted((tuple(r) for r in token_store.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert sorted(os.listdir(folder)) == sorted(["dictionary.zstd", "manifest.json", *(f["name"] for f in json.load(open(f"{folder}/manifest.json"))["files"])])
    some = token_store.read(spark, folder, "doc_id long, n_tokens long, start long", doc_ids=[1, 7, 150, 10**9]).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((d, s) for d, s, *_ in want if d in (1, 7, 150))
    assert token_store.read(spark, folder, doc_ids=[]).collect() == []


def test_query_of_the_store(spark, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    ids, start, want = library_ids([r["text"] for r in rows]), 0, []
    for r, x in zip(rows, ids):
        want.append((r["doc_id"], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in QUERIES["op12_token_store"](spark, SF).collect()) == want


def test_store_of_an_empty_table_and_of_one_id(spark, tmp_path):
    """No rows give a store without files; equal rows of one id go to several files and keep gapless starts."""
    token_store.write(spark.createDataFrame([], NO_ROWS), vocabulary(WORDS), str(tmp_path / "none"))
    assert token_store.read(spark, str(tmp_path / "none")).collect() == []
    one = spark.range(2000).selectExpr("5L AS doc_id", "if(id % 2 = 0, 'same words', 'other words here') AS text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    token_store.write(one, vocabulary(WORDS), str(tmp_path / "one"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(json.load(open(tmp_path / "one" / "manifest.json"))["files"]) > 1
    rows = sorted(token_store.read(spark, str(tmp_path / "one")).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist() and len(rows) == 2000


def test_a_file_of_another_dictionary_is_refused(spark, documents, tmp_path):
    folder = str(tmp_path / "store")
    token_store.write(documents.limit(20), vocabulary(WORDS), folder)
    with open(f"{folder}/dictionary.zstd", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read(spark, folder).collect()


# 13: links between tokenizers


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(BYTES))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))


def brute_links(libraries, rows) -> list[tuple]:
    """Rows of the query by loops: token by token, link by link."""
    a, b = libraries
    from rillgraph.llm.bpe import byte_alphabet

    to_byte, found, held = byte_alphabet(), [], Counter()
    for doc_id, text in rows:
        digests, links = (0, 0, 0, 0, ""), Counter()
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
                groups, own, at = [], ([], []), [0, 0]
                merged = sorted([(int(e), 0, i) for e, i in zip(np.cumsum([len(x) for x in bytes_a]), ids_a)] + [(int(e), 1, i) for e, i in zip(np.cumsum([len(x) for x in bytes_b]), ids_b)])
                for e, side, i in merged:
                    own[side].append(i)
                    at[side] = e
                    if at[0] == at[1] and e in ends[0] & ends[1]:
                        groups.append(own)
                        own = ([], [])
                for x, y in groups:
                    links.update((i, j) for i in x for j in y)
                text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                digests = (len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(text_of.encode()).hexdigest())
        held.update(links.keys())
        found.append((doc_id, digests, links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    score = lambda links: (sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()))
    return sorted(((d, *x[:4], *score(links), x[4]) for d, x, links in found), key=str)


def test_links_match_loops(spark, odd, documents, libraries):
    more = [(k, t, "x", "x", 1) for k, t in enumerate(["<|endoftext|> </s> <s>", "a▁b", "▁", " lead", "trail \n", "a  b　 c", "é" * 600, "ab" * 700 + " " + "日本" * 300, "\x00 \x1f x", " ", "  two   spaces ", "🙂 " * 40])]
    docs = odd.unionByName(documents, allowMissingColumns=True).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in alignment.align(docs, vocabulary(BYTES), vocabulary(PIECES)).collect()), key=str)
    assert got == brute_links(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert alignment.align(spark.createDataFrame([], NO_ROWS), vocabulary(BYTES), vocabulary(PIECES)).collect() == []


def test_links_of_many_small_blocks_and_parts(spark, documents, libraries, monkeypatch):
    """Several blocks and several parts of a stripe give the same counts."""
    for name, value in (("BLOCK_ROWS", 7), ("PART_BLOCKS", 1), ("SMALL", 1), ("JOINED", 3)):
        monkeypatch.setattr(alignment, name, value)
    made = alignment.aligned(alignment.pair(vocabulary(BYTES), vocabulary(PIECES)), [1], ["some words\n and more"], 0, lambda x: x)
    assert [r[3:8] for r in made[:1]] == [[r[0], *r[1:5]] for r in brute_links(libraries, [(1, "some words\n and more")])]
    got = sorted((tuple(r) for r in alignment.align(documents, vocabulary(BYTES), vocabulary(PIECES)).collect()), key=str)
    assert got == brute_links(libraries, [(r["doc_id"], r["text"]) for r in documents.collect()])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab é日🙂\n\t ▁  　\x85\x1c.,'sS12<|>")), max_size=6))
def test_chunks_have_the_tokens_of_whole_texts(libraries, texts):
    """Chunks encoded once, joined or alone, are the libraries' ids of the whole text, wherever white space stands."""
    a, b = libraries
    p = alignment.pair(vocabulary(BYTES), vocabulary(PIECES))
    texts = [t for t in texts if t]
    if texts:
        distinct, index, per = alignment.chunked(texts)
        ids_a, ids_b, n_a, n_b, good = p.encode(distinct)
        own_a, own_b = np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1])
        for text, places in zip(texts, np.split(index, np.cumsum(per)[:-1])):
            assert "".join(distinct[k] for k in places) == " " + text
            same = b"".join(p.right.bytes[i].as_py() for i in b.encode(text)) == (" " + text).encode()
            assert good[places].all() == same
            if same:
                assert [i for k in places for i in own_a[k]] == a.encode(" " + text, add_special_tokens=False).ids
                assert [i for k in places for i in own_b[k]] == b.encode(text)


def test_the_audits_sql_and_query_agree(spark):
    same_rows(QUERIES["op11_divergence"](spark, SF), duck(SF), ORACLES["op11_divergence"])
