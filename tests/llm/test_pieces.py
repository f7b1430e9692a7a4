"""SentencePiece against the library."""
import pytest
import sentencepiece
from corpusql.llm import pieces

from brute import edge_rows, table

TEXTS = ["Hello world.  This is\n\na test\tœ 😀 x", "  leading and trailing  ", "a\0b", "internationalization " * 3, "=" * 80,
         " " * 100 + "x", "aaaaaaaaaaaaaaaaaaaa", "ﬁ é ß", "Ünïcode\r\nlines", "1234567890 3.14159", "x" * 400, "👩‍👩‍👧 한국어 日本語"]


def _encode(text, model):
    cut = model.cutter()
    return [i for word in cut.findall(model.escape(text)) for i in pieces.encode_word(word, model)]


def test_words_alone():
    model = pieces.Model.load(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert model.kind == pieces.BPE
    for text in TEXTS:
        assert _encode(text, model) == library.encode(text)


def _as_unigram(path):
    """The model file's bytes with its type set to unigram, and scores that fit one."""
    out = bytearray()
    with open(path, "rb") as f:
        data = f.read()

    def put(n):
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    for number, value in pieces._fields(data):
        if number == 2:        # trainer: model_type is field 3
            value = bytes([3 << 3, pieces.UNIGRAM]) + _without(value, 3)
        if isinstance(value, bytes):
            put(number << 3 | 2)
            put(len(value))
            out += value
    return bytes(out)


def _without(message, field):
    at, kept = 0, b""
    while at < len(message):
        start, tag, shift = at, 0, 0
        while True:
            tag |= (message[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 0x80:
                break
        if tag & 7 == 0:
            while message[at] >= 0x80:
                at += 1
            at += 1
        elif tag & 7 == 2:
            n, shift = 0, 0
            while True:
                n |= (message[at] & 0x7F) << shift
                at, shift = at + 1, shift + 7
                if message[at - 1] < 0x80:
                    break
            at += n
        else:
            at += 4 if tag & 7 == 5 else 8
        if tag >> 3 != field:
            kept += message[start:at]
    return kept


def test_viterbi_is_the_librarys_unigram(spark, tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(_as_unigram(pieces.MODEL))
    model = pieces.Model.load(str(path))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert model.kind == pieces.UNIGRAM
    words = sorted({w for t in ["Hello wonderful worlds of tokenisation", "unbelievable retitioning", "abcdefg hijkl éa 😀"]
                    for w in model.cutter().findall(model.escape(t))})
    got = {r.word: r.ids for r in pieces.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), model, ["word"]).collect()}
    assert len(got) >= 5
    for w in words:
        want = library.encode(w.replace(pieces.SPACE, " ").removeprefix(" "))
        if w.startswith(pieces.SPACE) and w in got:
            assert got[w] == want == pieces.encode_word(w, model)


def test_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.Model.load(pieces.MODEL)
    rows = edge_rows() + [(100 + k, t, "en", "a") for k, t in enumerate(TEXTS)]
    got = pieces.decode(pieces.encode(table(spark, rows), model), model).collect()
    texts = {i: t or "" for i, t, _, _ in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id]


def test_lattice_and_heap_agree(spark):
    model = pieces.Model.load(pieces.MODEL)
    words = ["▁the", "▁retitioning", "ouéaieuxlepa", "😀x", "▁" + "ab" * 25, "é", "x" * 61, "▁▁▁a", "\U0001F9FF"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = {r.word: r.ids for r in pieces.fold_words(df, model, ["word"]).collect()}
    assert set(found) == {"▁the", "▁retitioning", "ouéaieuxlepa", "▁" + "ab" * 25} and all(ids == pieces.encode_word(w, model) for w, ids in found.items())
    edges = pieces.lattice(df.where("word = '▁the'"), model, ["word"]).first().edges
    assert {(e >> 32 & 255, e >> 24 & 255) for e in edges} >= {(0, 2), (0, 4), (1, 4)}


def test_no_documents(spark):
    assert pieces.encode_documents(table(spark, [])).count() == 0


def test_cuts_lose_nothing():
    """Encoding between the cuts is the library's encoding, with long stretches without spaces too."""
    model = pieces.Model.load(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    cut = model.cutter()
    for text in [*TEXTS, "日本語と한국어と中文の長い文章で空白がない" * 40, "x=1;y=[2,3];" * 50, "no,spaces,at,all;just.punctuation/and\\slashes" * 9]:
        words = cut.findall(model.escape(text))
        assert "".join(words) == model.escape(text)
        assert [i for w in words for i in pieces.encode_word(w, model)] == library.encode(text)
    assert max(map(len, cut.findall("日本語と한국어と中文の長い文章で空白がない" * 40))) < pieces.LONGEST


def test_the_fold_runs_once_a_word(spark):
    """The merge fold is bound: no second copy of it inside a lambda of the plan."""
    model = pieces.Model.load(pieces.MODEL)
    df = spark.createDataFrame([("▁the",)], "word string")
    plan = pieces.fold_words(df, model, ["word"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(sort_array") == 1


def test_a_word_that_the_lattice_loses_raises(spark, monkeypatch):
    model = pieces.Model.load(pieces.MODEL)
    whole = pieces.fold_words
    monkeypatch.setattr(pieces, "fold_words", lambda *a: whole(*a).where("word != '▁world'"))
    with pytest.raises(Exception, match="lost a word"):
        pieces.encode(table(spark, [(1, "hello world", "en", "a")]), model).collect()


def test_a_word_is_folded_once_for_all_blocks(spark, monkeypatch):
    """Every partition is a block of its own, and the blocks' words are dealt by themselves."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.Model.load(pieces.MODEL)
    whole, asked = pieces.fold_words, []

    def folded(words, *more):
        asked.append(words)
        return whole(words, *more)
    monkeypatch.setattr(pieces, "fold_words", folded)
    rows = [(k, f"the same words in every text 😀 and{'x' * k} {'=' * 70}", "en", "a") for k in range(12)] + [(12, None, "en", "a"), (13, "", "en", "a")]
    got = {r.doc_id: r.ids for r in pieces.encode(table(spark, rows).repartition(6), model).collect()}
    assert got == {k: library.encode(t or "") for k, t, _, _ in rows}
    words = [r.word for df in asked for r in df.select("word").collect()]
    assert "▁same" in words and len(words) == len(set(words))


def test_words_of_a_column_are_those_of_its_texts():
    import pyarrow as pa
    model = pieces.Model.load(pieces.MODEL)
    cut = model.cutter()
    texts = [None, "", *TEXTS, "", None, "日本語と한국어", ""]
    for column in (pa.array(texts), pa.array(["x y", *texts, "z"]).slice(1, len(texts)), pa.array(["", None]), pa.array([], pa.string())):
        words, ends = cut.words(model.escaped(column))
        bounds = [0, *ends.tolist()]
        assert [words.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [cut.findall(model.escape(t)) for t in column.to_pylist()]
