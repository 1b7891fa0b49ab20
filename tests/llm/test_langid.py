import random

import numpy as np
import pytest

from quillon.llm import langid
from quillon.llm.langid import label_code, languages, letters, repaired, sentences

PHRASES = {
    "en": ["The gateway has lost the list of open links.", "Please check the oldest segment before you restart the node.", "We saw that nobody noticed the missing batch."],
    "de": ["Das Gateway hat die Liste der offenen Verbindungen verloren.", "Bitte prüfe zuerst das älteste Segment vor dem Neustart.", "Wir haben gesehen, dass niemand den fehlenden Stapel bemerkt hat."],
    "fr": ["La passerelle a perdu la liste des liens en attente.", "Vérifiez d'abord le segment le plus ancien avant de relancer.", "Nous avons vu que personne n'a remarqué le lot manquant."],
    "es": ["La pasarela perdió la lista de los enlaces pendientes.", "Revisa primero el segmento más antiguo antes de reiniciar.", "Vimos que nadie se dio cuenta del lote que faltaba."],
    "pt": ["O coletor perdeu a lista das ligações pendentes.", "Verifique primeiro o segmento mais antigo antes de reiniciar.", "Vimos que ninguém percebeu o lote que estava em falta."],
    "ru": ["Шлюз потерял список открытых связей.", "Сначала проверьте самый старый сегмент перед запуском.", "Мы увидели, что никто не заметил пропавшую пачку."],
    "zh": ["网关丢掉了所有待处理的链接。", "请先检查最旧的数据段，然后再重启。", "我们发现没有人注意到缺失的批次。"],
    "ja": ["ゲートウェイは未処理のリンクの一覧を失いました。", "再起動する前に、いちばん古い区画を確かめてください。", "足りない束に誰も気づきませんでした。"],
}
S = "doc_id long, text string, lang string, label string, segment int, row int"


def train_rows(n=25):
    r = random.Random(2)
    return [(c, " ".join(r.sample(p, 2)) if c not in ("zh", "ja") else "".join(r.sample(p, 2))) for c, p in PHRASES.items() for _ in range(n)]


def frame(spark, extra):
    base = train_rows()
    rows = [(i, t, c if i % 9 else "en", "x", 1, 2) for i, (c, t) in enumerate(base)]
    return spark.createDataFrame(rows + [(10_000 + i, t, lab, "x", 1, 2) for i, (t, lab) in enumerate(extra)], S), len(rows)


@pytest.fixture(scope="module")
def found(spark):
    p = PHRASES
    extra = [
        (p["en"][0] + " " + p["fr"][1] + "\n" + p["zh"][0], None), (p["es"][1].upper(), "pt"), ("Bitte prufe zuerst das alteste Segment vor dem Neustart. (图存储)", "de"), (p["fr"][2].encode().decode("latin-1"), "fr"),
        ("SELECT name FROM pump WHERE price > 5 LIMIT 3;\n{\"a\": 3.5}\np50=7ms", "en"), ("", "en"), (None, "en"), (" \n\t", None), (" ".join(p["ru"]) * 400, "Russian"), ("...", "en"),
    ]
    df, n = frame(spark, extra)
    return languages(df).collect(), n


def test_accuracy_on_held_out_and_wrong_labels(found):
    rows, n = found
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.lang)
        assert 0 <= r.confidence <= 1 and (0 < r.share <= 1 or r.lang is None)
    truth = [c for c, _ in train_rows()]
    assert sum(got[i] == {truth[i]} for i in range(n)) / n > 0.99
    assert got[10_000] == {"en", "fr", "zh"} and got[10_001] == {"es"} and got[10_002] == {"de"} and got[10_003] == {"fr"} and got[10_008] == {"ru"}
    assert len(got) == n + 10  # every document has a row
    rest = {r.doc_id: r for r in rows if r.doc_id in (10_004, 10_005, 10_006, 10_007, 10_009)}
    assert all(r.sentences == 0 for r in rest.values()) and {k for k, r in rest.items() if r.lang is None} == {10_005, 10_006, 10_007, 10_009}
    assert all(r.confidence == 0 for r in rest.values() if r.lang is None)


def test_segments(spark):
    p = PHRASES
    df, _ = frame(spark, [(p["en"][0] + " " + p["en"][1] + " " + p["de"][0] + " " + p["en"][2], "en")])
    rows = sorted((r.segment, r.lang, r.sentences) for r in languages(df, segments=True).where("doc_id = 10000").collect())
    assert rows == [(0, "en", 2), (1, "de", 1), (2, "en", 1)]


def test_labels(spark):
    say = {"EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "English": "en", "zh_Hans": "zh", "zho": "zh", " German ": "de", "xx": None, "": None, "unknown": None, "n/a": None, None: None, "japanese": "ja", "end": None}
    df = spark.createDataFrame([(k,) for k in say], "lang string")
    assert {r.lang: r.c for r in df.select("lang", label_code("lang").alias("c")).collect()} == say


def test_pieces():
    assert repaired("perdiÃ³ Ã¡rea") == "perdió área" and repaired("naïve Ãb") == "naïve Ãb"
    assert sentences("One two three four. v1.2.3\nx = 3.5;\nIt ran on.\nNo.") == [" one two three four ", " it ran on "]
    assert sentences("Das ist gut.") == [" das ist gut "]
    assert sentences("Wir haben den fehlenden\nStapel nicht bemerkt,\nund niemand fragte danach.\nSELECT 1;\nEnde gut.") == [" wir haben den fehlenden stapel nicht bemerkt und niemand fragte danach ", " ende gut "]
    assert sentences("网关丢掉了所有\n待处理的链接。") == [" 网关丢掉了所有待处理的链接 "]
    assert letters("We saw (a rather long remark in brackets, which goes on and on and on and on and on) nothing.") == " we saw nothing "
    assert letters("(Wir sahen nichts.)") == " wir sahen nichts "


def test_short_wrapped_and_unmarked(spark):
    p = PHRASES
    df, _ = frame(spark, [("Wir haben gesehen, dass\nniemand den fehlenden Stapel bemerkt hat.", None), ("Please check the oldest segment before you restart the node", None), ("We saw that.", None)])
    got = {r.doc_id: (r.lang, r.sentences) for r in languages(df).where("doc_id >= 10000").collect()}
    assert got == {10_000: ("de", 1), 10_001: ("en", 0), 10_002: ("en", 1)}


def test_table_of_grams_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "KNOWN_GRAMS", 50)
    protos = np.random.default_rng(1).normal(size=(8, 64)).astype(np.float32)
    one = langid.Profiles(protos, np.zeros(0, np.int64), np.zeros((0, 8), np.float32))
    texts = [f" {a}{b}{c} " for a in "abcdef" for b in "ghijkl" for c in "mno"]
    every = one.products(texts)
    parts = np.concatenate([one.products(texts[k : k + 7]) for k in range(0, len(texts), 7)])
    assert len(one.grams.codes) <= 50 and np.allclose(every, parts, rtol=1e-4, atol=1e-3)
    codes, owner = langid.gram_codes(texts)
    want = np.zeros((len(texts), 8))
    np.add.at(want, owner, langid.gram_vectors(codes, 64, {}).astype(float) @ protos.T)
    assert np.allclose(every, want, rtol=1e-4, atol=1e-3)


def test_empty(spark):
    df, _ = frame(spark, [])
    assert languages(df.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "Some text without any label here.", None, "", 1, 1)], S)
    assert [(r.lang, r.sentences, r.confidence) for r in languages(unlabelled).collect()] == [(None, 0, 0.0)]  # nothing to learn from
