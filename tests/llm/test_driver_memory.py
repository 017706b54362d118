"""What the language model's fit took is given back: the driver lives on."""

from __future__ import annotations

from partition_audit.llm import buffers, language_crf


def test_the_driver_keeps_no_table_of_the_fit(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(language_crf, "give_back_memory", lambda: calls.append(len(buffers._powers[0])))
    rows = [("the cat sat on the mat", "en"), ("le chat est sur le lit", "fr")]
    model = language_crf.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr"]
    assert calls[-1] == 1 and len(buffers._powers[0]) == 1


def test_a_fit_hashes_its_sample_in_pieces():
    buffers.forget_powers()
    texts = [" ".join(f"{word}{i}" for i in range(60_000)) for word in ("cat", "chat")]
    model = language_crf.fit(texts, ["en", "fr"])
    assert len(buffers._powers[0]) < sum(map(len, texts)) // 2
    best, _ = language_crf.predict(model, language_crf.pa.array(["cat1 cat2 cat3", "chat1 chat2 chat3"]))
    assert [model.languages[i] for i in best] == ["en", "fr"]


def test_words_hash_alike_in_pieces_and_at_once(monkeypatch):
    data, places = buffers.text_buffer(language_crf.pa.array(["a bb ccc", "", "bb " + "d" * 50 + " a"]))
    begin, end, _ = buffers.word_spans(data, places)
    whole = buffers.span_hashes(buffers.prefix_sums(data), begin, end)
    for step in (1, 4, 9, 1000):
        monkeypatch.setattr(language_crf, "HASH_BYTES", step)
        assert (language_crf._word_hashes(data, begin, end) == whole).all()


def test_features_are_alike_in_pieces_and_at_once(monkeypatch):
    data, places = buffers.text_buffer(language_crf.pa.array(["a bb ccc dddd", "eeeee ffffff"]))
    begin, end, _ = buffers.word_spans(data, places)
    whole = [x.tolist() for x in language_crf._sorted_features(data, begin, end)]
    for words in (1, 2, 5):
        monkeypatch.setattr(language_crf, "FIT_WORDS", words)
        assert [x.tolist() for x in language_crf._sorted_features(data, begin, end)] == whole
