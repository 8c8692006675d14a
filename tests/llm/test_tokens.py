"""Token tables, packing and the BPE codec against the tokenizers library."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docframe.llm import bpe, packing, token_store
from docframe.llm.token_cache import CachedEncoder, encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(struct.pack(f"<{len(numbers)}I", *numbers))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbe st\n\t'sre\x1c\xa0 ÉΣς12<|>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    assert encoder(BYTE).encode([text])[0].tolist() == ids(BYTE, text)
    plain = ids(WORD, text)
    assert encoder(WORD).encode([text])[0].tolist() == plain
    codec = bpe.codec(WORD)
    assert codec.encode(text).tolist() == plain
    assert codec.decode(np.array(plain, np.int64)) == LIBRARY[WORD].decode(plain, skip_special_tokens=False)


def test_a_word_is_merged_once_and_stays_while_rare_ones_go(monkeypatch):
    codec, made = bpe.BacktrackingBpe(WORD), []
    word = codec.word
    monkeypatch.setattr(codec, "word", lambda symbols: made.append(symbols) or word(symbols))
    codec._known._half, codec._merged._half = 8, 4
    for k in range(60):
        text = f"Zqxvorth, zqxvorth. zqxvorth{chr(97 + k % 26)}{chr(97 + k // 26)}"
        assert codec.encode(text).tolist() == ids(WORD, text)
    assert made.count("zqxvorth" + bpe._END) == 1


def test_a_word_is_merged_once_whatever_marks_follow(monkeypatch):
    spaced, made = CachedEncoder(BYTE), []
    merge = spaced._merge
    monkeypatch.setattr(spaced, "_merge", lambda symbols: made.append(symbols) or merge(symbols))
    spaced._cache._half = 12
    for text in ("a zqxvorth zqxvorth, zqxvorth. zqxvorth?!", *(f"it's zqxvorth, x{k}y don't 'zq' (éa), é\u0301! zqxvorth. b\nb" for k in range(60))):
        assert spaced.encode([text])[0].tolist() == ids(BYTE, text)
    assert made.count("Ġzqxvorth") == 1


def test_every_vocabulary_word_is_itself():
    codec = bpe.codec(WORD)
    by_symbol = {s: b for b, s in enumerate(codec._byte)}
    for token in codec.strings:
        if token.endswith("</w>"):
            assert codec.word("".join(token[:-4]) + bpe._END) == [LIBRARY[WORD].token_to_id(token)]
    assert len(by_symbol) == 256


def test_token_table(spark, odd, empty, tmp_path):
    path = str(tmp_path / "t")
    token_store.write_token_table(odd, WORD, path, 1)
    got = token_store.with_checksum(token_store.read_token_table(spark, path)).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert [r["doc_id"] is None for r in got] == sorted((d is None for d, _ in rows), reverse=True)
    named = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert named == sorted(named) and len(got) == len(rows)
    at = 0
    want = defaultdict(list)
    for d, t in rows:
        want[d].append((len(ids(WORD, t)) + 1, crc([*ids(WORD, t), 1])))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    found = token_store.read_token_table(spark, path, [4, 8]).orderBy("doc_id").collect()
    assert [r["ids"] for r in found] == [[*ids(WORD, t), 1] for d, t in rows if d in (4, 8)]
    token_store.write_token_table(empty, WORD, str(tmp_path / "e"), 1)
    assert token_store.read_token_table(spark, str(tmp_path / "e")).isEmpty()


def check_packing(rows, texts, capacity, path=BYTE):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, found in pieces.items():
        wanted = sorted([*ids(path, t), 2] for d, t in texts if d == doc_id)
        found.sort(key=lambda r: r["piece"])
        if len(wanted) == 1:
            at = 0
            for k, r in enumerate(found):
                part = wanted[0][r["start"] : r["start"] + r["length"]]
                assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(part)) and (k == 0 or r["length"] == capacity)
                at += r["length"]
            assert at == len(wanted[0]) and (len(found) == 1) == (at <= capacity)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, odd, empty, documents):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows = packing.pack_documents(odd, BYTE, 2, 64).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in texts}
    check_packing(rows, texts, 64)
    assert packing.pack_documents(empty, BYTE, 2, 64).isEmpty()
    rows = packing.pack_documents(documents, BYTE, 2).collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], 1024)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_sequences_hold_the_ids(spark, odd):
    packed = packing.pack_documents(odd, BYTE, 2, 64, keep_ids=True).cache()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] and crc(r["ids"]) == r["ids_crc32"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_plan_places_each_length_once(lengths):
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, int)
    plan, opened = packing.plan_runs(counts, 50)
    held = np.zeros(opened, int)
    for r in plan.sort_values("offset").itertuples():
        assert (held[r.first_sequence : r.first_sequence + r.many] == r.offset).all()
        held[r.first_sequence : r.first_sequence + r.many] += r.length
    assert (held <= 50).all() and held.sum() == sum(lengths)
    for size, part in plan.groupby("length"):
        at = 0
        for r in part.sort_values("first_rank").itertuples():
            assert r.first_rank == at
            at += r.many
        assert at == counts[size]
    # first-fit decreasing, by brute force, is not better by more than a sequence or a fiftieth
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, b in enumerate(bins) if b + x <= 50), None)
        if k is None:
            bins.append(x)
        else:
            bins[k] += x
    assert opened <= len(bins) + 1 + len(bins) // 50


def test_encode_decode_rows(odd, empty):
    texts = odd.collect()
    got = bpe.encode_decode(odd, WORD, digests=True).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, hashlib.sha256(" ".join(map(str, ids(WORD, r["text"]))).encode()).hexdigest(), hashlib.sha256(LIBRARY[WORD].decode(ids(WORD, r["text"]), skip_special_tokens=False).encode()).hexdigest()) for r in texts)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    plain = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(odd, WORD).filter("doc_id = 6").collect()}
    assert plain[6] == (ids(WORD, "the same five words here"), LIBRARY[WORD].decode(ids(WORD, "the same five words here"), skip_special_tokens=False))
    assert bpe.encode_decode(empty, WORD).isEmpty()


def test_encoded_bytes_are_the_ids():
    from docframe.llm.token_cache import CachedEncoder

    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["", "One two  three", "naïve Ünïcode 数", "a <|b|>"]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    found = CachedEncoder(path).encode_bytes(texts)
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in found] == want
