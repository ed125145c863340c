import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from transitlake.llm import shared, token_ids

ODD = [
    "", " ", "It's we'll I'D don't 'S ''t", "a\tb\x0bc\x0cd\re\x85f\xa0g", "ÀÉÎ ß µ ª º ² ½ × ÷ þ Þ ÿ", "a­b", "x<|endoftext|>y <|startoftext|> z <|ENDOFTEXT|>", "İstanbul ΣΑΣ Σ", "é é", "漢字かな 日本語",
    "\x1ca\x1db\x1ec\x1f\x00d", "“quoted” – dash — … €5", "a b​c d", "12345 3.14 1,000", "_under__score__ a_b", "x" * 3000, "😀 emoji👍🏽", "ﬁ ligature ①", "ab " * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_ids.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(library):
    encode = token_ids.encoder(token_ids.default_tokenizer()).encode
    assert token_ids.encoder(token_ids.default_tokenizer()).by_words
    for text in [*ODD, *map(chr, range(0, 0x2100)), *(f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}B" for c in range(0, 0x2100))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(library, text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0xFF), st.sampled_from("'sStTlLdDmMvVeErR<|>endoftx ’—é́")), max_size=40))
def test_encoder_on_any_text(text):
    library = Tokenizer.from_file(token_ids.default_tokenizer()) if not hasattr(test_encoder_on_any_text, "t") else test_encoder_on_any_text.t
    test_encoder_on_any_text.t = library
    assert np.frombuffer(token_ids.encoder(token_ids.default_tokenizer()).encode(text), "<u4").tolist() == ids_of(library, text)


def test_other_splits_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    made, library = token_ids.TokenEncoder(path), Tokenizer.from_file(path)
    assert not made.by_words
    assert all(np.frombuffer(made.encode(t), "<u4").tolist() == ids_of(library, t) for t in ODD)


def want(library, rows):
    """doc_id, start, n_tokens, ids_crc32 in order; equal ids are compared as a group, as only their texts' hashes order them."""
    out = []
    for doc_id, text in rows:
        data = np.array([*ids_of(library, text), 1], dtype="<u4").tobytes()
        out.append((doc_id, len(data) // 4, zlib.crc32(data)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("file_bytes", [32_000_000, 20_000])
def test_round_trip(spark, monkeypatch, library, odd_docs, file_bytes):
    monkeypatch.setattr(token_ids, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(token_ids, "READ_BYTES", file_bytes // 4)
    folder = shared.shared_dir(spark, "token-ids")
    manifest = token_ids.write_token_ids(odd_docs, folder)
    got = token_ids.read_token_ids(manifest, folder).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == want(library, odd_docs.select("doc_id", "text").collect())
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert manifest.count() > 1 or file_bytes > 20_000


def test_null_ids_large_ids_and_one_hot_id(spark, library):
    big = 2**53 + 1
    rows = [(None, "b"), (None, "a"), (big, "x"), (big + 2, "y"), (-5, None), (7, "a"), *[(7, f"text {i}") for i in range(200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = shared.shared_dir(spark, "token-ids")
    got = token_ids.read_token_ids(token_ids.write_token_ids(docs, folder), folder).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == want(library, rows)


def test_fetch(spark, monkeypatch, library, odd_docs):
    monkeypatch.setattr(token_ids, "FILE_BYTES", 20_000)
    folder = shared.shared_dir(spark, "token-ids")
    manifest = token_ids.write_token_ids(odd_docs, folder)
    texts = {}
    for r in odd_docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    asked = [3, 20, 30, 30, 61, 10**6, None]
    found = token_ids.fetch_token_ids(manifest, folder, spark.createDataFrame([(i,) for i in asked], "doc_id long")).collect()
    expected = [(i, [*ids_of(library, t), 1]) for i in {a for a in asked if a is not None} for t in texts.get(i, [])]
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted(expected)


def test_no_documents(spark, no_docs):
    folder = shared.shared_dir(spark, "token-ids")
    manifest = token_ids.write_token_ids(no_docs, folder)
    assert token_ids.read_token_ids(manifest, folder).count() == 0
    assert token_ids.fetch_token_ids(manifest, folder, no_docs).count() == 0


def test_a_changed_dictionary_is_noticed(spark, odd_docs):
    folder = shared.shared_dir(spark, "token-ids")
    manifest = token_ids.write_token_ids(odd_docs, folder)
    fs, base = shared.filesystem(folder)
    with fs.open_output_stream(f"{base}/{manifest.first().dictionary}.dictionary") as f:
        f.write(b"another dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_ids.read_token_ids(manifest, folder).collect()


def test_frames_are_documents_and_the_dictionary_helps(spark, odd_docs):
    import zstandard

    folder = shared.shared_dir(spark, "token-ids")
    row = token_ids.write_token_ids(odd_docs, folder).first()
    fs, base = shared.filesystem(folder)
    with fs.open_input_stream(f"{base}/{row.dictionary}.dictionary") as f:
        dictionary = f.read()
    found = token_ids.IdFile(fs.open_input_file(f"{base}/{row.path}"), dictionary)
    sizes = np.diff(found.offsets)
    alone = [len(zstandard.ZstdCompressor(level=3).compress(ids)) for _, ids in found.documents(np.arange(len(sizes)))]
    assert sum(sizes) < sum(alone) and len(sizes) == row.n_docs
