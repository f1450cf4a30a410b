import public_tokenizers
import pyarrow as pa
import pytest

from vistalake.llm import kernel, ngram_join, packing, quality, wordwise

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_work_without_a_tokenizer_begins_without_its_memo():
    wordwise.word_encoder(PATH).word_numbers([b"some words to keep"])
    held = []

    @wordwise.light
    def work(batches):
        for b in batches:
            held.append(wordwise.word_encoder.cache_info().currsize)
            yield b

    assert list(work(iter([1, 2]))) == [1, 2] and held == [0, 0]


@pytest.mark.parametrize("work", [lambda docs: quality.score(docs, None), lambda docs: ngram_join.members(docs.withColumnRenamed("doc_id", "id"))], ids=["quality", "ngram_join"])
def test_other_work_frees_what_a_tokenizer_has_learnt(spark, work):
    # one worker: it packs, then does other work
    docs = spark.createDataFrame([(i, f"word{i} and more of them") for i in range(50)], "doc_id long, text string").coalesce(1)
    packing.token_pieces(docs, PATH).collect()
    work(docs).collect()

    def learnt(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([wordwise.word_encoder.cache_info().currsize], pa.int64())], ["n"])

    assert [r.n for r in docs.mapInArrow(learnt, "n long").collect()] == [0]


def test_new_words_are_encoded_in_bounded_calls(monkeypatch):
    encoder = wordwise.WordEncoder(PATH)
    words = [f"w{i}x{i * 7919 % 1000}" for i in range(3 * encoder.JOINED * encoder.TOGETHER + 5)]
    sizes, call = [], encoder.model.encode_batch_fast

    class Model:
        def encode_batch_fast(self, groups, **given):
            sizes.append(len(groups))
            return call(groups, **given)

    monkeypatch.setattr(encoder, "model", Model())
    numbers, _ = encoder.numbered(*kernel.as_bytes(pa.array([" ".join(words)])))
    assert len(sizes) == 4 and max(sizes) == encoder.TOGETHER
    plain = wordwise.WordEncoder(PATH).model.encode(" ".join(words), add_special_tokens=False).ids
    assert encoder.ids_of(numbers).tolist() == plain
