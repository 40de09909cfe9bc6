"""A worker's next block does not encode again the words it has just encoded."""
import pyarrow as pa

from colloquy.llm import bpe, queries


def test_words_of_the_block_before(monkeypatch):
    path, asked, encode = queries.vocabulary_path(), [], bpe.encode_words
    monkeypatch.setattr(bpe, "_HELD", {})
    monkeypatch.setattr(bpe, "encode_words", lambda p, words: asked.extend(pa.array(words).to_pylist()) or encode(p, words))
    one = [" red", " green", "blue", "\n", " “so", " 　", " <|endoftext|>", ""]
    two = [" grey", "blue", " red", " é", "\n"]
    for words in (one, two, one, []):
        found = bpe.encode_distinct(path, pa.array(words, pa.large_string()))
        assert found.to_pylist() == [bpe.tokenizer(path).encode(w, add_special_tokens=False).ids for w in words]
    assert sorted(asked) == sorted({*one, *two})


def test_held_words_stay_bounded(monkeypatch):
    path = queries.vocabulary_path()
    monkeypatch.setattr(bpe, "_HELD", {})
    monkeypatch.setattr(bpe, "_HELD_WORDS", 5)
    for i in range(6):
        words = [f" w{i}x{j}" for j in range(3)] + [" all"]
        found = bpe.encode_distinct(path, pa.array(words, pa.large_string()))
        assert found.to_pylist() == [bpe.tokenizer(path).encode(w, add_special_tokens=False).ids for w in words]
        assert len(bpe._HELD[path][0]) <= 5
