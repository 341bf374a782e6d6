"""Observations from texts: questions, decisions, tasks and facts, sentence by sentence, in the words of their language.

A sentence is judged by the lexicon of its text's language, or by the English one if there is
none. A question goes before a decision, a decision before a task, a task before a fact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import lookup as lk, text as tx
from cairn.operators.relational import spread

# Words that tell decisions and tasks, and verbs that open a task, by language.
DECISIONS = {
    "en": ["decided", "decision", "agreed", "approved", "ratified", "signed off", "sign-off", "go-live approved", "rejected"],
    "es": ["decidido", "decidida", "decidimos", "decisión", "acordado", "acordada", "acordamos", "aprobado", "aprobada", "ratificado", "ratificada", "firmado", "firmada", "rechazado", "rechazada"],
    "fr": ["décidé", "décidée", "décidons", "décision", "convenu", "convenue", "approuvé", "approuvée", "ratifié", "ratifiée", "signé", "signée", "rejeté", "rejetée"],
    "de": ["beschlossen", "entschieden", "vereinbart", "genehmigt", "bestätigt", "abgelehnt", "ratifiziert", "unterzeichnet"],
    "ja": ["決定", "決まり", "決まりました", "合意", "承認", "批准", "署名", "却下", "判定", "確定", "採用", "見送り", "保留", "了承", "承諾", "否決", "見送", "延期", "中止", "導入", "合意形成", "最終決定", "正式決定", "暫定決定"],
    "zh": ["决定", "決定", "同意", "批准", "通过", "通過", "签字", "簽字", "驳回", "駁回", "确认", "確認", "采纳", "採納", "暂缓", "暫緩", "否决", "否決", "审批", "審批", "同意了", "通过了", "决定了", "确定了", "否决了", "采纳了", "延期", "延緩", "取消", "中止", "終止", "导入", "導入", "立项", "立項", "决议", "決議", "拍板", "定下来"],
    "ar": ["تقرر", "قررنا", "قرار", "موافق", "اعتمد", "اعتماد", "صادق", "وقع", "رفض"],
}
TASKS = {
    "en": ["todo", "action", "task", "please", "fyi action", "follow up", "follow-up"],
    "es": ["tarea", "pendiente", "por favor", "favor de", "acción", "seguimiento"],
    "fr": ["à faire", "tâche", "action", "merci de", "s'il vous plaît", "s'il te plaît", "suivi"],
    "de": ["aufgabe", "bitte", "to-do", "todo", "nachverfolgung", "follow-up"],
    "ja": ["タスク", "アクション", "お願い", "してください", "フォローアップ", "実施", "対応", "準備", "期限", "提出期限", "お願いします", "お願いいたします", "担当", "担当者", "進める", "進行", "完了", "未完了", "予定", "スケジュール", "ベンダー", "確認依頼", "レビュー", "提出", "締め切り", "優先", "優先度"],
    "zh": ["任务", "任務", "请", "請", "麻烦", "麻煩", "跟进", "跟進", "实施", "實施", "准备", "準備", "期限", "完成", "待办", "待辦", "请帮忙", "請幫忙", "负责", "負責", "负责人", "負責人", "推进", "推進", "进度", "進度", "已完成", "未完成", "计划", "計畫", "截止", "提交", "优先", "優先", "供应商", "供應商", "审阅", "審閱", "落实", "落實"],
    "ar": ["مهمة", "من فضلك", "يرجى", "متابعة", "إجراء"],
}
VERBS = {
    "en": ["draft", "send", "schedule", "review", "publish", "fix", "deploy", "ship", "investigate", "prepare", "update", "merge"],
    "es": ["redacta", "envía", "programa", "revisa", "publica", "arregla", "despliega", "investiga", "prepara", "actualiza", "fusiona", "verifica"],
    "fr": ["rédige", "envoie", "planifie", "vérifie", "publie", "corrige", "déploie", "lance", "investigue", "prépare", "mets", "fusionne"],
    "de": ["schreibe", "sende", "plane", "prüfe", "veröffentliche", "behebe", "deploye", "untersuche", "bereite", "aktualisiere", "merge"],
    "ja": [], "zh": [],
    "ar": ["اكتب", "أرسل", "جدول", "راجع", "انشر", "أصلح", "وزع", "تحقق", "حضر", "حدث", "ادمج"],
}
# Words that are no names although they may begin in upper case; a caller may give those of other languages.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "if", "then", "this", "that", "these", "those", "it", "he", "she", "we", "you", "they", "i", "is", "are", "was", "were", "be", "to", "of", "in", "on", "at", "for", "with", "by", "from", "as", "not"]
# Kinds of entities in the order in which they are looked for, and how sure each is.
ENTITIES = {"mention": 0.85, "name": 0.55, "cjk_term": 0.5, "cjk_person": 0.6, "cjk_organisation": 0.65, "url": 0.9, "email": 0.9, "date": 0.6, "number": 0.7}
# How sure an observation of each kind is.
SURE = {"question": 0.7, "decision": 0.75, "task": 0.7, "fact": 0.5}


def _said(low: Column, table: dict[str, list[str]], language: Column) -> Column:
    """Whether one of a language's words is there: one pattern for each language, chosen by its tag."""
    out = None
    for tag, words in table.items():
        if words and tag != "en":
            hit = low.rlike(tx.any_of(words))
            out = F.when(language == tag, hit) if out is None else out.when(language == tag, hit)
    return out.otherwise(low.rlike(tx.any_of(table["en"])))


def _opens(low: Column, verbs: dict[str, list[str]], language: Column) -> Column:
    """Whether a sentence begins with a verb of its language that opens a task."""
    first = tx.first_token(low)
    pair = tx.first_bigram(low)  # a language may say with two words what others say with one
    out = F.when(language == "ar", lk.in_table(first, verbs.get("ar", []), lk.ARABIC_CLITICS))
    for tag, words in verbs.items():
        if tag not in ("en", "ar"):
            one, two = [w for w in words if " " not in w], [w for w in words if " " in w]
            hit = first.isin(one) if one else F.lit(False)
            out = out.when(language == tag, hit | F.coalesce(pair.isin(two), F.lit(False)) if two else hit)
    return out.otherwise(first.isin(verbs["en"]))


def kind(sentence: Column, low: Column, terminator: Column, language: Column, lexicon: Lexicon) -> Column:
    """question, decision, task or fact; null if it is none of these. low: the sentence in lower case."""
    return (
        F.when(terminator.isin("?", "？", "؟"), "question").when(_said(low, lexicon.decisions, language), "decision").when(_said(low, lexicon.tasks, language) | _opens(low, lexicon.verbs, language), "task")
        .when((F.octet_length(sentence) >= 6) & tx.fact_shaped(sentence), "fact")
    )


@dataclass(frozen=True)
class Lexicon:
    """Words of languages by tag; a caller may add languages of their own, and English must be among them."""

    decisions: dict[str, list[str]]
    tasks: dict[str, list[str]]
    verbs: dict[str, list[str]]

    def __post_init__(self):
        if not all("en" in table for table in (self.decisions, self.tasks, self.verbs)):
            raise ValueError("a lexicon has English words for texts of other languages")

    def adding(self, tag: str, decisions: list[str], tasks: list[str], verbs: list[str] = ()) -> Lexicon:
        return Lexicon({**self.decisions, tag: decisions}, {**self.tasks, tag: tasks}, {**self.verbs, tag: list(verbs)})


LEXICON = Lexicon(DECISIONS, TASKS, VERBS)


def entities(texts: DataFrame, id_column: str = "doc_id", kinds: tuple[str, ...] = tuple(ENTITIES), stop: list[str] = STOP_WORDS) -> DataFrame:
    """``(id, kind, content, confidence)``: what a whole text names, each content once, as the first kind that finds it. A null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    finds = {
        "mention": lambda: tx.mentions(text), "name": lambda: F.filter(tx.capitalised(text, []), lambda w: ~F.lower(w).isin(stop)), **{f"cjk_{k}": (lambda k=k: F.transform(F.filter(lk.cjk_nouns(text), lambda n: n["kind"] == k), lambda n: n["content"])) for k in ("term", "person", "organisation")}, "url": lambda: tx.urls(text),
        "email": lambda: tx.emails(text), "date": lambda: F.concat(tx.day_or_month(text), tx.quarters(text)), "number": lambda: tx.amounts(text),
    }
    of = lambda kind: F.transform(finds[kind](), lambda c: F.struct(c.alias("content"), F.lit(list(ENTITIES).index(kind)).alias("place"), F.lit(kind).alias("kind"), F.lit(ENTITIES[kind]).alias("confidence")))
    rows = spread(texts.select(id_column, "text")).select(id_column, F.array_sort(F.concat(*map(of, kinds))).alias("e"))
    first = F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["content"] != x["content"]))
    return rows.select(id_column, F.explode(first).alias("e")).select(id_column, "e.kind", "e.content", "e.confidence")


def observations(texts: DataFrame, id_column: str = "doc_id", language: str = "language_tag", lexicon: Lexicon = LEXICON) -> DataFrame:
    """``(id, kind, content, confidence)``, one row for each sentence that is an observation.

    A null text has none; a null language, or one without a lexicon, is read as English.
    """
    tag = F.substring_index(F.lower(F.coalesce(language, F.lit("en"))), "-", 1)
    rows = spread(texts.select(id_column, tag.alias("tag"), "text")).select(id_column, "tag", F.explode(tx.raw_sentences(F.col("text"))).alias("raw"))
    # each step is a column of its own, so that nothing is worked out twice
    rows = rows.select(id_column, "tag", "raw", F.regexp_extract(F.right("raw", F.lit(1)), f"[{tx.SENTENCE_END}]", 0).alias("end"))
    rows = rows.select(id_column, "tag", "end", F.trim(F.expr("left(raw, length(raw) - length(end))")).alias("content")).where("content <> ''")
    rows = rows.select(id_column, "tag", "end", "content", F.lower("content").alias("low"))
    found = rows.select(id_column, kind(F.col("content"), F.col("low"), F.col("end"), F.col("tag"), lexicon).alias("kind"), "content").where("kind is not null")
    sure = F.create_map(*[x for k, v in SURE.items() for x in (F.lit(k), F.lit(v))])
    return found.select(id_column, "kind", "content", sure[F.col("kind")].alias("confidence"))


def turn_kind(text: Column) -> Column:
    """What a single turn of a conversation is expected to be: the first rule that fits."""
    low = F.lower(text)
    return (
        F.when(low.startswith("todo") | low.contains("action item"), "task")
        .when(low.startswith("what ") | low.startswith("how ") | low.contains("?"), "question")
        .when(low.rlike("decided|approved|agreed"), "decision").when(low.contains("reminder"), "task")
        .when(low.rlike("resolved|complete|restored"), "fact").when(low.rlike("^(?:lol|ok|nice|thanks|great|looks|welcome|numbers)"), "noise").otherwise("fact")
    )


# ---- how well


def confusion(judged: DataFrame, expected: str, predicted: str) -> DataFrame:
    """``(kind, tp, fp, fn)`` of rows that have an expected and a predicted kind; a null is no kind."""
    same = F.col(expected).eqNullSafe(F.col(predicted)).alias("same")
    sides = F.array(F.struct(F.col(expected).alias("kind"), F.lit(True).alias("wanted"), same), F.struct(F.col(predicted).alias("kind"), F.lit(False).alias("wanted"), same))
    each = judged.select(F.explode(sides).alias("k")).select("k.*").where("kind is not null")
    return each.groupBy("kind").agg(F.count_if(F.col("wanted") & F.col("same")).alias("tp"), F.count_if(~F.col("wanted") & ~F.col("same")).alias("fp"), F.count_if(F.col("wanted") & ~F.col("same")).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; each is 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    out = counts.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def macro_f1(counts: DataFrame) -> DataFrame:
    """The mean of f1 over kinds; 0 if there is none."""
    return scores(counts).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro"))
