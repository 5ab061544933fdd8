"""Defective prompt-response pairs: a story (title, summary) and its translation (title_zh, summary_zh).

A multi-label linear classifier (logistic, one weight vector per defect) on hashed character n-grams, hashed
endings and pair features (shares of scripts, overlap with the source, shared names, lengths, a mark of a cut) is
trained on responses made defective on purpose: cut, copied from their own source (also labelled, re-cased, with words
left out), swapped for another story's text or another script, or refused. Refusals are put together from parts in
several languages; nothing but the model decides about them, so ones put together otherwise are found by their n-grams. The base of
training is a sample of at most ``SAMPLE`` pairs, drawn by hash; its own suspicious members are left out after a first
round by pair features and a second, of each half by a model of the other. A fifth of the pairs is held out, with refusals of parts that training never sees, to calibrate one threshold per
defect. Applying the model covers every pair and every whole text, a batch as one array.

'empty' needs no model: it is an exact check for null, blank or placeholder text, and goes first, then 'copy'; 'truncated' goes last. Of the
others the one that exceeds its threshold most is given. Overlap is counted against every record
of the story, by joins of hashed pieces, so that a copy of any of them is seen. A pair whose story is missing or has no
text can't be a copy. An empty table gives an empty result; repeated rows each count; more columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import titles
from tidewright.llm.truncation import stripped

#: Pairs the classifier is trained on, at most.
SAMPLE = 2000
LABELS = ("refusal", "copy", "wrong_language", "truncated")
COPY = LABELS.index("copy")
#: Labels that n-grams and endings speak for: a copy is a relation to the source, which pair features show.
SAID = np.array([1.0, 0.0, 1.0, 1.0])
BITS, TAIL_BITS = 18, 14
#: Characters of a piece that is compared with the source.
PIECE = 5

# Placeholders beside those without any letter or digit.
PLACEHOLDER = re.compile(r"^\W*(?:n/?a|none|null|nil|undefined|tbd|todo|nan|無|无|暫無(?:摘要|標題|內容)?|暂无(?:摘要)?|待補|待翻譯|略|空|未提供|無摘要|無標題|沒有內容|untitled|title|summary|summary_zh|title_zh)?\W*$", re.I)
_INVISIBLE = re.compile(r"[\s​-‏⁠﻿]+")
_LABEL = re.compile(r"^\s*(?:摘要|標題|翻譯|譯文|導讀|原文|中文|summary_zh|title_zh|summary|title|translation)\s*[:：]\s*", re.I)
_QUOTED = re.compile(r"「[^「」]*」|『[^『』]*』|《[^《》]*》|“[^“”]*”|\"[^\"]*\"|（[^（）]*）|https?://\S+")
#: Tags, addresses and a short remark in brackets behind a text are no part of it.
_BEHIND = re.compile(r"(?:\s*(?:(?:#\S+|\S{0,8}[:：]?\s*https?://[^\s/]+/\S+)\s*)+|(?<=[。！？])（[^（）]{1,12}）\s*)$")
_WORD = re.compile(r"[a-zà-ÿ0-9]+")
_NAME = re.compile(r"[A-Za-z]{4,}")

# Parts of refusals by language: openings, that it can't be done, what can't be done, reasons. {} stands for the subject.
PARTS = {
    "zh": (
        ("很抱歉，", "抱歉，", "對不起，", "不好意思，", "恕我直言，", "非常遺憾，", "請見諒，", ""),
        ("我無法", "我不能", "我沒有辦法", "恕難", "本系統不便", "身為語言模型，我不會", "作為人工智慧助理，我沒有能力", "我必須婉拒", "目前不支援", "我被禁止", "本次不予"),
        ("協助處理這個請求", "翻譯這段文字", "為這篇內容產生摘要", "撰寫 {} 的導讀", "回答這個問題", "完成這項任務", "改寫 {} 的內容", "提供您要的資訊", "對 {} 多作說明", "執行這項指示"),
        ("。", "，因為未提供全文。", "，此請求涉及版權。", "，輸入內容不符合使用政策。", "，請直接閱讀原文。", "，這超出我能處理的範圍。", "，請洽原作者。", "，我無從開啟連結或閱讀附件。", "，請改問其他問題。", "，基於安全考量。"),
    ),
    "zh_s": (
        ("很抱歉，", "对不起，", "很遗憾，", "不好意思，", ""),
        ("我无法", "我不能", "作为人工智能助手，我没有能力", "我必须拒绝", "暂不支持", "恕难"),
        ("完成这个请求", "提供该内容的摘要", "翻译这段文字", "回答这个问题", "为 {} 撰写导读"),
        ("。", "，因为没有提供全文。", "，请直接阅读原文。", "，这违反了使用政策。", "，请尝试其他问题。"),
    ),
    "en": (
        ("I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologize, but ", "Regrettably, ", "As an AI language model, ", "Thank you for asking, however ", ""),
        ("I cannot ", "I can't ", "I am unable to ", "I won't be able to ", "I must decline to ", "I'm not able to ", "it is not possible for me to ", "my guidelines do not allow me to ", "I don't feel comfortable to ", "I have to refuse to "),
        ("help with that", "provide a summary of {}", "translate this text", "complete this request", "write the guide for {}", "process this document", "answer this question", "assist with this task", "access the article", "open links or attachments"),
        (".", " because the full text was not supplied.", " as it may be protected by copyright.", ". Please consult the original source.", ". This falls outside what I can do.", " due to our content policy.", ". Please ask something else.", ", since the input violates the usage policy."),
    ),
    "ja": (("申し訳ありませんが、", "恐れ入りますが、", "AIとして、", "残念ながら、", ""), ("この文書を", "そのリクエストを", "{} の内容を", "この質問に"), ("要約することはできません", "翻訳できません", "お応えできません", "処理することはできかねます", "お手伝いできません"), ("。", "。原文をご覧ください。", "。ポリシーに反するためです。")),
    "ko": (("죄송하지만 ", "유감스럽게도 ", "AI로서 ", ""), ("이 요청을 ", "이 문서를 ", "{} 내용을 ", "이 질문에 "), ("처리할 수 없습니다", "요약할 수 없습니다", "번역해 드릴 수 없습니다", "답변드릴 수 없습니다"), (".", ". 원문을 참고해 주세요.", ". 정책에 위배됩니다.")),
    "fr": (("Je suis désolé, mais ", "Désolé, ", "Malheureusement, ", ""), ("je ne peux pas ", "je ne suis pas en mesure de ", "il m'est impossible de ", "je refuse de "), ("répondre à cette demande", "résumer ce document", "traduire ce texte", "traiter {}"), (".", ", car le texte complet n'a pas été fourni.", ". Veuillez consulter la source.")),
    "de": (("Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", ""), ("kann ich ", "darf ich ", "ist es mir nicht möglich, "), ("diese Anfrage nicht bearbeiten", "diesen Text nicht übersetzen", "{} nicht zusammenfassen", "dabei nicht helfen"), (".", ", da der Volltext fehlt.", ". Bitte lesen Sie das Original.")),
    "es": (("Lo siento, pero ", "Lamentablemente, ", "Disculpa, ", ""), ("no puedo ", "no me es posible ", "no tengo permitido "), ("ayudar con esta solicitud", "resumir {}", "traducir este texto", "procesar el documento"), (".", " porque falta el texto completo.", ". Consulte la fuente original.")),
    "pt": (("Desculpe, mas ", "Infelizmente, ", ""), ("não posso ", "não consigo ", "não estou autorizado a "), ("ajudar com este pedido", "resumir {}", "traduzir este texto"), (".", " porque falta o texto completo.", ". Consulte a fonte original.")),
    "ru": (("Извините, но ", "К сожалению, ", ""), ("я не могу ", "я не в состоянии ", "мне запрещено "), ("помочь с этим запросом", "перевести этот текст", "кратко изложить {}"), (".", ", так как полный текст не предоставлен.", ". Обратитесь к источнику.")),
}
# Sentences in other languages than the wanted one, that decline nothing. {} stands for the subject, # for a number.
OTHERS = {
    "zh_s": ("作者提出了 {}，用于处理这一任务，并在资源受限时保持稳定。", "实验表明，该方法在公开数据集上将准确率提高了 # 个百分点。", "该团队同时开放了源代码和 # 条标注样本，便于复现。", "不过实验只覆盖了少数领域，能否推广还需要进一步验证。", "总体来看，瓶颈在于数据质量，而不是模型规模。", "与 # 个基线相比，训练时间缩短了一半。", "论文还讨论了失败的情况以及可能的改进方向。"),
    "en": ("The paper presents {}, a method that stays stable under tight budgets.", "On public data the accuracy rises by # points.", "Code and # labelled examples are released.", "The experiments cover few domains only, so it remains open how far the results carry over.", "The bottleneck is the quality of data rather than the size of the model.", "Compared with # baselines the training time is cut in half.", "In practice the component can be turned off at inference."),
    "ja": ("本研究では {} を提案し、限られた計算資源でも安定して動作することを示す。", "公開データでの精度は # ポイント向上した。", "コードと # 件の注釈付きデータも公開されている。", "ただし、実験は一部の分野に限られており、一般化には検証が必要である。", "学習時間は従来の # 手法の半分で済む。", "全体として、課題はモデルの規模ではなくデータの質にある。"),
    "ko": ("이 연구는 {}라는 새로운 방법을 제안하며 제한된 자원에서도 안정적이다.", "공개 데이터에서 정확도가 # 포인트 높아졌다.", "코드와 # 개의 주석 표본이 함께 공개되었다.", "다만 실험은 일부 분야만 다루어 일반화는 더 확인해야 한다.", "기존 # 개 방법보다 학습 시간이 절반으로 줄었다.", "전체적으로 병목은 모델 크기가 아니라 데이터 품질이다."),
    "fr": ("Ce travail présente {}, une méthode légère qui reste stable avec peu de mémoire.", "Sur les corpus publics, la précision progresse de # points.", "Le code et # exemples annotés sont fournis pour faciliter la reproduction.", "Les essais ne couvrent que quelques domaines, et la portée des résultats reste à vérifier.", "En production, le module peut être désactivé sans perte.", "Le goulot d'étranglement tient à la qualité des données."),
    "de": ("Die Arbeit stellt {} vor, ein Verfahren, das auch bei knappem Speicher stabil bleibt.", "Auf öffentlichen Datensätzen steigt die Genauigkeit um # Punkte.", "Der Code und # annotierte Beispiele liegen bei, damit sich die Läufe wiederholen lassen.", "Die Versuche decken nur wenige Bereiche ab.", "Im Betrieb lässt sich der Baustein abschalten, ohne das Modell neu zu trainieren.", "Der Engpass liegt in der Qualität der Daten."),
    "es": ("Este trabajo presenta {}, un método ligero que se mantiene estable con poca memoria.", "En datos públicos la precisión sube # puntos.", "Se publican el código y # ejemplos anotados para facilitar la reproducción.", "Los ensayos solo cubren algunos dominios y queda por ver si se generaliza.", "En producción el módulo se puede apagar.", "El cuello de botella está en la calidad de los datos."),
    "pt": ("Este trabalho apresenta {}, um método leve que permanece estável com pouca memória.", "Em dados públicos a precisão sobe # pontos.", "O código e # exemplos anotados são publicados.", "Os testes cobrem apenas alguns domínios."),
    "ru": ("В работе представлен {}, метод, устойчивый при нехватке памяти.", "На открытых данных точность выросла на # пункта.", "Код и # размеченных примеров опубликованы.", "Опыты охватывают лишь несколько областей."),
}
#: How often each language is drawn.
DRAWN = ("zh", "zh", "zh", "zh", "zh_s", "en", "en", "en", "ja", "ko", "fr", "de", "es", "pt", "ru")


@lru_cache(maxsize=40_000)
def script(sign: str) -> str:
    """han_s and han_t: characters of only the simplified or only the traditional standard sets."""
    code = ord(sign)
    if 0x4E00 <= code <= 0x9FFF:
        in_set = []
        for codec in ("gb2312", "big5"):
            try:
                sign.encode(codec)
                in_set.append(True)
            except UnicodeEncodeError:
                in_set.append(False)
        return {(True, False): "han_s", (False, True): "han_t"}.get(tuple(in_set), "han")
    if 0x3041 <= code <= 0x30FF:
        return "kana"
    if 0xAC00 <= code <= 0xD7A3:
        return "hangul"
    return "letter" if sign.isalpha() else "other"


SCRIPTS = ("han", "han_s", "han_t", "kana", "hangul", "letter")


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """The number of the script of every code point; characters beyond the first 0x30000 are neither."""
    found = np.full(0x110000, len(SCRIPTS), dtype=np.uint8)
    for code in range(0x30000):
        kind = script(chr(code))
        if kind != "other":
            found[code] = SCRIPTS.index(kind)
    script.cache_clear()
    return found


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and the text each belongs to."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def script_shares(texts: list[str]) -> np.ndarray:
    """(text, script): the share of each script among the letters, Latin words counting half a sign a letter since they run longer."""
    codes, owner = codes_of(texts)
    wide = len(SCRIPTS) + 1
    counts = np.bincount(owner * wide + script_table()[codes], minlength=len(texts) * wide).reshape(len(texts), wide)[:, :-1].astype(float)
    counts[:, -1] /= 2
    return counts / np.maximum(1e-9, counts.sum(axis=1, keepdims=True))


def foreign(shares: np.ndarray) -> np.ndarray:
    """Share of each text that isn't Traditional Chinese; Japanese and Simplified Chinese share most of its characters
    and count as a whole by those they don't."""
    han, simplified, traditional, kana = shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3]
    whole = (kana > 0.12) | ((simplified > 0.08) & (simplified > 2 * traditional))
    return np.where(whole, 1.0, np.where(shares.sum(axis=1) > 0, 1 - han - traditional - simplified, 0.0))


def pieces(text: str) -> set[str]:
    """The words of a text, ``PIECE`` characters at a time."""
    words = " ".join(_WORD.findall(text.lower()))
    return {words[i : i + PIECE] for i in range(max(1, len(words) - PIECE + 1))} if words else set()


def contained(text: str, source: set[str]) -> float:
    own = pieces(_LABEL.sub("", text))
    return len(own & source) / len(own) if own and source else 0.0


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(codes: np.ndarray, owner: np.ndarray, n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram inside a text."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    last = len(codes) - n + 1
    value = np.full(last, kind * 31 + n, dtype=np.uint64)
    for k in range(n):
        value = (value ^ codes[k : k + last].astype(np.uint64)) * _MIX
        value ^= value >> np.uint64(29)
    whole = owner[:last] == owner[n - 1 :]
    return owner[:last][whole], (value[whole] >> np.uint64(64 - BITS)).astype(np.int64)


#: Lengths of the endings that are features of their own.
ENDINGS = (1, 2, 3, 4, 6, 8)
DENSE = 26


class Rows:
    """Features of pairs: n-grams that occur (where each row's begin, and all of them in order), endings (one of each length), dense ones."""

    def __init__(self, begin: np.ndarray, grams: np.ndarray, tails: np.ndarray, dense: np.ndarray):
        self.begin, self.grams, self.tails, self.dense = begin, grams, tails, dense

    def pick(self, at: np.ndarray, bare: np.ndarray) -> Rows:
        """The rows ``at``; those marked ``bare`` without their n-grams."""
        sizes = np.where(bare, 0, np.diff(self.begin)[at])
        ends = np.cumsum(sizes)
        place = np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Rows(np.r_[0, ends], self.grams[place], self.tails[at], self.dense[at])


def features(title: list[str], summary: list[str], in_title: np.ndarray, in_summary: np.ndarray) -> Rows:
    """``in_title`` and ``in_summary``: how much of each is contained in the source."""
    bare, marked = map(list, zip(*[stripped(s) for s in summary], strict=True)) if summary else ([], [])
    bare = [_BEHIND.sub("", b) or b for b in bare]
    body = [_LABEL.sub("", b) for b in bare]
    prose = [_QUOTED.sub("", b) or b for b in body]
    said = [_QUOTED.sub("", t) or t for t in title]
    laid = codes_of(body)
    rows, hashed = (np.concatenate(x) for x in zip(_ngrams(*codes_of(title), 2, 1), *[_ngrams(*laid, n, 2) for n in (2, 3)], strict=True))
    unique = np.unique(rows << BITS | hashed)
    rows, hashed = unique >> BITS, unique & ((1 << BITS) - 1)
    begin = np.searchsorted(rows, np.arange(len(title) + 1))
    tails = np.zeros((len(title), len(ENDINGS)), dtype=np.int64)
    for k, n in enumerate(ENDINGS):
        ends = ["".join("a" if c.isascii() and c.isalpha() else c for c in re.sub(r"\d+", "9", b[-n - 8 :])[-n:]).rjust(n, "\0") for b in bare]  # all digits are one, all Latin letters
        if ends:
            tails[:, k] = _ngrams(*codes_of(ends), n, 3)[1] >> (BITS - TAIL_BITS)
    st, ss = script_shares(said), script_shares(prose)
    ft, fs = foreign(st), foreign(ss)
    it, is_ = in_title * (st[:, 5] > 0.5), in_summary * (ss[:, 5] > 0.5)
    size = np.array([len(s) for s in summary], dtype=float)
    names = [set(map(str.lower, _NAME.findall(t))) for t in title]
    named = np.array([bool(n) and any(x in s for x in n) for n, s in zip(names, map(str.lower, body), strict=True)], dtype=float)
    labelled = np.array([bool(_LABEL.match(b)) for b in bare], dtype=float)
    dense = np.column_stack([
        np.ones(len(title)), st[:, 5], st[:, 3], st[:, 4], np.minimum(1, 4 * st[:, 1]), st[:, 2], ss[:, 5], ss[:, 3], ss[:, 4], np.minimum(1, 4 * ss[:, 1]), ss[:, 2],
        it, is_, it > 0.7, is_ > 0.7, ft, fs, ft > 0.5, fs > 0.5, (np.maximum(ft, fs) > 0.5) & (np.maximum(it, is_) < 0.6),
        np.array(marked, dtype=float).reshape(-1), named, np.minimum(2, size / 200), size < 60, labelled, ss[:, 3] > 0.12,
    ]).astype(float)
    return Rows(begin, hashed, tails, dense)


def empty(text: str | None) -> bool:
    return text is None or bool(PLACEHOLDER.match(_INVISIBLE.sub(" ", text)))


def _spoil(rng: np.random.Generator, text: str) -> str:
    """A copy, slightly changed or labelled."""
    kind = rng.integers(6)
    words = text.split(" ")
    if kind == 0:
        return text.upper()
    if kind == 1:
        return text.lower()
    if kind == 2:
        return " ".join(w for w in words if rng.random() > 0.08)
    if kind == 3:
        return ("摘要：", "翻譯：", "summary_zh: ", "標題：")[rng.integers(4)] + text
    if kind == 4 and len(words) > 8:
        return " ".join(words[: int(len(words) * rng.uniform(0.4, 0.9))])
    return text


def _foreign(rng: np.random.Generator, text: str, other: str, subject: str, held: bool) -> str:
    """Another story's source text, sentences of another language, or the text with characters of another script."""
    kind = rng.integers(6)
    if kind == 0 and other:
        return other
    if kind <= 3:
        language = list(OTHERS)[int(rng.integers(len(OTHERS)))]
        known = [s for k, s in enumerate(OTHERS[language]) if (k % 3 == 1) == held]
        picked = [known[int(k)] for k in rng.permutation(len(known))[: int(rng.integers(1, len(known) + 1))]]
        return ("" if language in ("zh_s", "ja") else " ").join(picked).replace("{}", subject).replace("#", str(int(rng.integers(2, 90_000))))
    if kind == 4:  # Japanese keeps some of the characters
        share = rng.uniform(0.25, 0.75)
        return "".join(chr(int(rng.integers(0x3042, 0x3094))) if script(c).startswith("han") and rng.random() < share else c for c in text)
    return "".join(_SIMPLIFIED[int(rng.integers(len(_SIMPLIFIED)))] if script(c).startswith("han") and rng.random() < 0.35 else c for c in text)


_SIMPLIFIED = [c for c in map(chr, range(0x4E00, 0x9FA6)) if script(c) == "han_s"]


def _refuse(rng: np.random.Generator, subject: str, held: bool, languages: tuple[str, ...] = DRAWN) -> str:
    """A refusal of random parts; ``held``: of those parts (every fourth) that training never uses."""
    language = languages[int(rng.integers(len(languages)))]
    out = ""
    for _ in range(int(rng.integers(1, 3))):
        for parts in PARTS[language]:
            some = [p for k, p in enumerate(parts) if (k % 4 == 1) == held] or list(parts)
            out += some[int(rng.integers(len(some)))]
        out += "" if language in ("zh", "zh_s", "ja") else " "
    return out.strip().replace("{}", subject)


def synthetic(pairs: list[tuple[str, str, str, str]], seed: int = 7, held: bool = False) -> tuple[Rows, np.ndarray]:
    """Features of each pair as it is and spoilt in every way, with its labels."""
    rng, rows, labels = np.random.default_rng(seed), [], []
    for k, (title, summary, st, ss) in enumerate(pairs):
        other = pairs[(k * 7 + 13) % len(pairs)]
        subject = (re.findall(r"[A-Za-z]{4,}", title) or ["X"])[0]
        cut = summary[: max(4, int(len(summary) * rng.uniform(0.2, 0.97)))]
        decimals = [m.end() for m in re.finditer(r"\d\.(?=\d)", summary)]
        if decimals and rng.random() < 0.15:
            cut = summary[: decimals[int(rng.integers(len(decimals)))]]
        while cut and cut[-1] in "。！？":
            cut = cut[:-1]
        cut += ("", "", "", "…", "...", "⋯⋯", "�")[int(rng.integers(7))]
        made = [((title, summary), ()), ((title, cut), ("truncated",))]
        made += [((title, _refuse(rng, subject, held)), ("refusal",)) for _ in range(2)]
        source = (st, ss, f"{st}\n{ss}")[int(rng.integers(3))]
        if source.strip():
            made.append(((title, _spoil(rng, source)), ("copy",)))
        if st.strip() and rng.random() < 0.4:
            made.append(((_spoil(rng, st), summary), ("copy",)))
        swapped = _foreign(rng, summary, other[3], subject, held)
        if swapped != summary:
            mixed = summary.split("。")[0] + "。" + swapped if rng.random() < 0.2 and len(swapped) > 150 else swapped
            made.append(((title, mixed), ("wrong_language",)))
        swapped = _foreign(rng, title, other[2], subject, held)
        if swapped != title and rng.random() < 0.4:
            made.append(((swapped, summary), ("wrong_language",)))
        known = pieces(st) | pieces(ss)
        for (t, s), given in made:
            rows.append((t, s, contained(t, known), contained(stripped(s)[0], known)))
            labels.append([float(label in given) for label in LABELS])
    t, s, it, is_ = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
    return features(t, s, np.array(it), np.array(is_)), np.array(labels).reshape(-1, len(LABELS))


class Model:
    """Weights of n-grams, endings and dense features, a column per label."""

    def __init__(self):
        self.grams, self.tails, self.dense = np.zeros((1 << BITS, len(LABELS))), np.zeros((1 << TAIL_BITS, len(LABELS))), np.zeros((DENSE, len(LABELS)))
        self.limits = np.full(len(LABELS), np.inf)

    def scores(self, rows: Rows) -> np.ndarray:
        """Log-odds per row and label."""
        out, sizes = rows.dense @ self.dense + self.tails[rows.tails].sum(axis=1), np.diff(rows.begin)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] += np.add.reduceat(self.grams[rows.grams], rows.begin[:-1][some], axis=0) / np.sqrt(sizes[some])[:, None]
        return out


#: Share of the training examples that are shown without their n-grams, so that the pair features learn what they can alone.
BARE = 0.3


def _step(weights: np.ndarray, seen: np.ndarray, at: np.ndarray, push: np.ndarray, rate: float) -> None:
    """AdaGrad on the rows ``at`` (which may repeat) of a table of weights."""
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    unique = at[order][edges]
    total = np.add.reduceat(push[order], edges, axis=0) + 1e-3 * weights[unique]
    seen[unique] += total**2
    weights[unique] -= rate * total / np.sqrt(seen[unique])


def train(rows: Rows, labels: np.ndarray, epochs: int = 5, rate: float = 0.2, seed: int = 3, bare: float = BARE) -> Model:
    """AdaGrad on the logistic loss of every label, a small batch at a time."""
    rng, model = np.random.default_rng(seed), Model()
    seen_g, seen_t, seen_d = (np.full_like(w, 1e-2) for w in (model.grams, model.tails, model.dense))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            batch = rows.pick(at, rng.random(len(at)) < bare)
            wrong = 1 / (1 + np.exp(-np.clip(model.scores(batch), -30, 30))) - labels[at]
            said = wrong * SAID
            sizes = np.diff(batch.begin)
            if len(batch.grams):
                share = said / np.sqrt(np.maximum(1, sizes))[:, None]
                _step(model.grams, seen_g, batch.grams, share[np.repeat(np.arange(len(at)), sizes)], 0.5 * rate)
            if bare < 1:
                _step(model.tails, seen_t, batch.tails.ravel(), np.repeat(said, len(ENDINGS), axis=0), 0.5 * rate)
            push = batch.dense.T @ wrong
            seen_d += push**2
            model.dense -= rate * push / np.sqrt(seen_d)
    return model


def calibrate(given: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per label the log-odds with the best F1, sound rows weighing as much as they do in practice (ten to one); of
    log-odds that do equally well one near the lower end, as what is made defective on purpose is the plainer case."""
    limits, sound = np.zeros(len(LABELS)), labels.sum(axis=1) == 0
    for l in range(len(LABELS)):
        own = labels[:, l] > 0
        if not own.any():
            continue
        tried = np.unique(np.quantile(given[:, l], np.linspace(0, 1, 401)))
        hit = np.array([(given[own, l] >= x).sum() for x in tried])
        false = np.array([10 * (given[sound, l] >= x).sum() + (given[~own & ~sound, l] >= x).sum() for x in tried])
        f1 = 2 * hit / np.maximum(1, hit + false + own.sum())
        best = tried[f1 >= f1.max() - 1e-9]
        limits[l] = best.min() + (best.max() - best.min()) / 4
    return limits


#: Log-odds from which a pair is left out of the base of training: what is sound lies far below.
SUSPICIOUS = -2.0
#: At least this share of the base stays, however unsure a model of few pairs is.
MOST_SOUND = 0.7


def _unsuspected(model: Model, pairs: list[tuple[str, str, str, str]], limit: float) -> list[tuple[str, str, str, str]]:
    """The pairs to which the model gives no defect."""
    if not pairs:
        return []
    t, s, st, ss = map(list, zip(*pairs, strict=True))
    known = [pieces(a) | pieces(b) for a, b in zip(st, ss, strict=True)]
    given = features(t, s, np.array([contained(x, k) for x, k in zip(t, known, strict=True)]), np.array([contained(x, k) for x, k in zip(s, known, strict=True)]))
    worst = model.scores(given).max(axis=1)
    limit = max(limit, float(np.quantile(worst, MOST_SOUND)))
    return [p for p, x in zip(pairs, worst, strict=True) if x <= limit]


def fit(pairs: list[tuple[str, str, str, str]]) -> Model:
    """The trained model with its thresholds, from pairs most of which are sound."""
    if not pairs:
        return Model()
    sound = _unsuspected(train(*synthetic(pairs[: len(pairs) // 3 + 1]), epochs=3, bare=1.0), pairs, 0.0)
    # then each half by a model of the other, which can't know its defects by heart
    halves = sound[::2], sound[1::2]
    sound = [p for own, other in (halves, halves[::-1]) for p in _unsuspected(train(*synthetic(other or own), epochs=3), own, SUSPICIOUS)] or pairs
    cut = len(sound) * 4 // 5 if len(sound) >= 10 else len(sound)
    model = train(*synthetic(sound[:cut], seed=11))
    rows, labels = synthetic(sound[cut:] or sound, seed=13, held=True)
    model.limits = calibrate(model.scores(rows), labels)
    return model


def sources(stories: DataFrame) -> DataFrame:
    """(story_id, source_title, source_summary): one row per story, whole title and longest summary, in one aggregation."""
    title = F.when(titles.whole(F.col("title")), F.trim("title"))
    core = F.when(titles.usable(F.col("title")), titles.core(F.col("title")))
    return stories.where(F.col("story_id").isNotNull()).groupBy("story_id").agg(
        F.max(F.struct(title.isNotNull().alias("whole"), F.length(F.coalesce(title, core)).alias("size"), F.coalesce(title, core).alias("text"))).alias("t"),
        F.max(F.struct(F.length("summary").alias("size"), F.col("summary").alias("text"))).alias("s"),
    ).select("story_id", F.col("t.text").alias("source_title"), F.col("s.text").alias("source_summary"))


def _hashed_pieces(text: Column) -> Column:
    """The hashes of :func:`pieces` as an expression."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^a-zà-ÿ0-9]+", " "))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - PIECE + 1)), lambda k: F.xxhash64(F.substring(w, k, F.lit(PIECE))))
    # the array binds the words, which would else be worked out again for every piece
    return F.array_distinct(F.flatten(F.transform(F.filter(F.array(words), lambda w: w != ""), cut)))


def overlaps(pairs: DataFrame, stories: DataFrame) -> DataFrame:
    """(row_id, in_title, in_summary): how much of title_zh and summary_zh, where mostly in letters, is contained in the titles and
    summaries of all records of the story. Pieces are joined by story and hash, so no story's records meet in one task."""
    # well below the share of letters from which a copy is looked for, as quotations still count here
    lettered = lambda c: F.length(F.regexp_replace(c, r"[^A-Za-z]", "")) > 1.2 * F.length(F.regexp_replace(c, r"[^\x{3041}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]", ""))
    label = _LABEL.pattern
    asked = pairs.where(F.col("story_id").isNotNull()).select("row_id", "story_id", *[F.when(lettered(F.col(c)), F.regexp_replace(F.col(c), "(?i)" + label, "")).alias(c) for c in ("title_zh", "summary_zh")])
    asked = asked.where(F.col("title_zh").isNotNull() | F.col("summary_zh").isNotNull())
    own = asked.select("row_id", "story_id", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("title_zh").alias("text")), F.struct(F.lit(1).alias("which"), F.col("summary_zh").alias("text")))).alias("p"))
    own = own.select("row_id", "story_id", F.col("p.which").alias("which"), F.explode(_hashed_pieces(F.col("p.text"))).alias("piece"))
    texts = stories.select("story_id", F.explode(F.array("title", "summary")).alias("text")).where(F.col("text").isNotNull()).join(asked.select("story_id").distinct(), "story_id", "left_semi").distinct()
    held = texts.select("story_id", F.explode(_hashed_pieces(F.col("text"))).alias("piece")).distinct().withColumn("hit", F.lit(1))
    met = own.join(held, ["story_id", "piece"], "left").groupBy("row_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("which") == k, F.coalesce("hit", F.lit(0)))) / F.count_if(F.col("which") == k), F.lit(0.0)).alias(name) for k, name in ((0, "in_title"), (1, "in_summary"))]
    )
    return met


_RESULT = pa.schema([("row_id", pa.int64()), ("defect", pa.string())])


def defects(translations: DataFrame, stories: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(row_id, defect) of each defective pair."""
    pairs = translations.select("row_id", "story_id", "title_zh", "summary_zh")
    # the smallest hashes are a sample that doesn't depend on order or partitions
    fair = pairs.where(F.length(F.trim("title_zh")).between(4, 400) & F.length(F.trim("summary_zh")).between(16, 8000))
    drawn = fair.orderBy(F.xxhash64("row_id")).limit(sample)
    drawn = drawn.join(sources(stories.join(drawn.select("story_id"), "story_id", "left_semi")), "story_id", "left").orderBy(F.xxhash64("row_id")).collect()
    base = [(r.title_zh, r.summary_zh, r.source_title or "", r.source_summary or "") for r in drawn if not empty(r.title_zh) and not empty(r.summary_zh)]
    model = pairs.sparkSession.sparkContext.broadcast(fit(base))
    met = pairs.join(overlaps(pairs, stories), "row_id", "left").select("row_id", "title_zh", "summary_zh", F.coalesce("in_title", F.lit(0.0)).alias("in_title"), F.coalesce("in_summary", F.lit(0.0)).alias("in_summary"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, title, summary = (batch.column(c).to_pylist() for c in ("row_id", "title_zh", "summary_zh"))
                none = np.array([empty(a) or empty(b) for a, b in zip(title, summary, strict=True)], dtype=bool)
                rows = features([t or "" for t in title], [s or "" for s in summary], batch.column("in_title").to_numpy(), batch.column("in_summary").to_numpy())
                over = model.value.scores(rows) - model.value.limits
                over[over[:, COPY] >= 0, COPY] = np.inf  # what stands in the source is nothing else
                over[(over[:, :-1] >= 0).any(axis=1), -1] = -np.inf  # where a text stops matters only in one that is none of the others
                first = np.where(none, 0, np.where((over >= 0).any(axis=1), over.argmax(axis=1) + 1, -1))
                hit = np.flatnonzero(first >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in hit], type=pa.int64()), pa.array([("empty", *LABELS)[first[k]] for k in hit], type=pa.string())], schema=_RESULT)

    return met.mapInArrow(judge, "row_id bigint, defect string")
