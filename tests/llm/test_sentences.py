import time

import pytest

from querndal.llm.sentences import enclosed, find_sentences, paragraphs, split_sentences, train
from querndal.runtime import table

TEXTS = {
    "According to B. P. Thale, it needs approx. 80 pages of Dr. Dravik. The tool accepts pdf, csv, etc. and skipped 20 pages.": 2,
    "The bundle holds pages, notes, etc. Why were the rows of Holinford counted twice? See Fig. 7 for the rest.": 3,
    'A contractor wrote, "The rows were cached. Nothing else changed." (The pages were split.) Was it the crawler?!': 3,
    "We waited... and the crawler finally counted the pages of Holinford.": 1,
    "Laut Dr. Thale braucht der Filter ca. 80 Seiten, z. B. jene aus Holinford. Am 19. September 2020 hat der Filter die Seiten gezählt.": 2,
    "El Sr. Dravik escribió: «Los turnos fueron exportados. En Pelehurst nada cambió». ¿Por qué fueron omitidos los campos de Claulnox a mano?": 2,
    "審查人員問：「文件準備好了嗎？」然後匯出了Holonzor的檔案。公告寫道：「回答已記錄。請重新登入Pelugate。」若題庫停止運作，請檢查記憶日誌。": 3,
    "「空の文書が多すぎる。」とGliallineの管理者は書いた。なぜGliallineの質問は手動で記録されたのですか？": 2,
    "डॉ. Dravik ने दस्तावेज़ जाँचे। क्या Plearpont के अंश हाथ से तैयार हुए?": 2,
    "ทำไมหน้าเว็บของFreedaleจึงหายไปตอนกลางคืน ค่าเกณฑ์3.70เพียงพอสำหรับหน้าเว็บของDruenpath": 2,
    "1. The answer cites a_log.csv, p. 22, and ignores it.\n\n2. Nobody knows why.\n \nNo end": 3,
    "Hard wrapped\ntext goes on. Then it\r\nends.": 2,
    "": 0,
    " \n\t ": 0,
    "no mark at all": 1,
}


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return train(docs.where("text is not null").select("text"))


@pytest.mark.parametrize("text", TEXTS)
def test_number_of_sentences(model, text):
    found = find_sentences(text, model)
    assert len(found) == TEXTS[text], [text[a:b] for a, b in found]


def test_each_character_belongs_to_one_sentence(model):
    for text in TEXTS:
        found = find_sentences(text, model)
        inside = set()
        for a, b in found:
            assert text[a:b].strip() == text[a:b] and not inside & set(range(a, b))
            inside |= set(range(a, b))
        assert all(c.isspace() for i, c in enumerate(text) if i not in inside)


def test_paragraphs_and_quotes():
    assert [t for t in map(lambda s: "a\r\nb\n\nc  d"[s[0] : s[1]], paragraphs("a\r\nb\n\nc  d"))] == ["a\r\nb", "c", "d"]
    assert enclosed('x "a (b) c" d „e“ (f') == [(2, 10), (14, 16)]


@pytest.mark.parametrize("text", ["คำ" * 500_000, "คำ" * 300_000 + " ต่อ", "aB." * 300_000, "(" * 200_000 + "]" * 200_000, '"a. " ' * 100_000, "7. " * 100_000, "x" * 1_000_000 + ". Y", "中" * 500_000, "ก." * 200_000 + " ข", "a.B@" * 100_000], ids=range(10))
def test_a_megabyte_of_anything_ends_soon(model, text):
    began = time.time()
    found = find_sentences(text, model)
    assert found[0][0] == 0 and found[-1][1] == len(text.rstrip()) and time.time() - began < 20


def test_marks_within_thai(model):
    text = "ค่าเกณฑ์3.70เพียงพอ ผู้ดูแลa.txtตรวจ"
    assert [text[a:b] for a, b in find_sentences(text, model)] == text.split(" ")


def test_table(spark, model):
    rows = [(1, "One here. Two there."), (1, "One here. Two there."), (2, None), (3, ""), (4, "x. " * 30_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, sent_no int")
    got = split_sentences(df, "doc_id", "text", model)
    assert got.where("doc_id = 1").count() == 4 and got.where("doc_id in (2, 3)").count() == 0
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0
