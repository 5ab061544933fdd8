"""Cut texts, defective pairs and entity matching on made-up rows and held-out examples."""

import json
import random
import re

import numpy as np

from tidewright.llm import entity_matching as em
from tidewright.llm import pair_defects as pd_
from tidewright.llm import truncation as tr

SENTENCES = ["The model is small and fast.", "We release all code and data.", "Results hold across three sizes.", "Training takes two days on one node.", "The cost grows with the number of layers.", "An ablation shows what matters most."]


def text(rng, n=4):
    return " ".join(rng.choice(SENTENCES) for _ in range(n))


def test_json_cut():
    whole = json.dumps({"a": ["x", {"b": 'q"'}], "summary": "Fine."})
    assert tr.json_cut(whole) == (False, json.loads(whole))
    assert all(tr.json_cut(whole[:k])[0] for k in range(1, len(whole)))
    for broken in ("", "  ", "null", "{'a': 'x'}", '{"a": 1,}', whole + whole, "﻿" + whole, "plain words"):
        assert not tr.json_cut(broken)[0], broken


def test_every_string_of_the_json_is_read(spark):
    nested = json.dumps({"a": [{"note": "All code is out. We release all code and"}, 5, None], "b": {"c": {"d": SENTENCES[0]}}})
    assert dict(tr.strings_in(json.loads(nested))) == {"note": "All code is out. We release all code and", "d": SENTENCES[0]}
    rows = [(k, "s", json.dumps({"x": {"note": text(random.Random(k), 5)}})) for k in range(300)] + [(900, "s", nested)]
    items = spark.createDataFrame(rows, "row_id long, source_id string, raw_json string")
    none = spark.createDataFrame([], "row_id long, model string, summary_zh string")
    found = {r.row_id for r in tr.cut_records(none, spark.createDataFrame([], "row_id long, source_id string, body string"), items).collect()}
    assert 900 in found and len(found) <= 3


def test_counts_beyond_32_bits(spark):
    """Counts of the model stay right above 2 ** 31, and one bucket never holds the sum of two contexts."""
    checks = [np.zeros(1 << b, dtype=np.uint32) for b in tr.BITS]
    ends, goes, within = ([np.zeros(1 << b, dtype=np.float32) for b in tr.BITS] for _ in range(3))
    s = tr.Suffixes(["the model is small."])
    for o, order in enumerate(tr.ORDERS):
        at = s.hashes[order][s.ends[0]]
        checks[o][at], ends[o][at], goes[o][at] = s.checks[order][s.ends[0]], 3_000_000_000, 5

    class Held:
        value = (checks, ends, goes, within)

    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"tbl": "releases", "row_id": 1, "source": "s", "field": "releases", "cut": False, "title": False, "text": "The model is small."}], schema=tr._VALUES)
    (out,) = list(tr._score(Held)(iter([batch])))
    assert np.log(3e9 / 6) - 0.1 < out.to_pylist()[0]["score"]
    for o in range(len(tr.ORDERS)):
        checks[o] += np.uint32(1)  # another context holds the buckets
    (out,) = list(tr._score(Held)(iter([batch])))
    assert out.to_pylist()[0]["score"] in (None, float("-inf"))


def test_suffixes_are_hashed_only_where_asked():
    """The places asked for have the hashes they have among all places; the rest is not worked out."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab 0123é語") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    s = tr.Suffixes(texts)
    assert not {"hashes", "checks"} & set(vars(s))
    places = np.concatenate([s.ends, tr._places(s, texts)])
    buckets, checks = s.hashes, s.checks
    for o, bucket, check in s.at(places):
        deep = s.depth[places] >= tr.ORDERS[o]
        assert deep.any() and (bucket == buckets[tr.ORDERS[o]][places])[deep].all() and (check == checks[tr.ORDERS[o]][places])[deep].all()


def test_ends_agree_with_whole_patterns():
    """The quick looks at the last signs and the last word say what patterns searched in the whole end say."""
    hanging = re.compile(r"(?:^|[\s(])(?:" + tr._HANGING.pattern + r")$", re.I)
    signs = re.compile("[" + re.escape(tr._OPEN_SIGN) + "]$")
    rng = random.Random(9)
    parts = ["the", "The", "e.g.", "via", "per", "model", "(", ")", "[", "]", " ", "  ", "\n", "|", "-", ":", "| a |", "|---|", "&amp", "&#12", "<b", "](x", ".", "...", "…", "…]", "[truncated", "[more]", "&hellip;", "(...)", "、", "語", "\u00a0", "```", "K", "ſee"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        bare, marked = tr.stripped(text)
        tail = text.rstrip()[-24:]
        sure, mark = tr._SURE_MARK.search(tail), tr._MARK.search(tail)
        assert (bare, marked) == (tail[: (sure or mark).start()].rstrip() if sure or mark else text.rstrip(), bool(sure)) or len(text.rstrip()) > 24
        if bare and "```" not in bare:
            line = bare[-400:].split("\n")[-1]
            ends = [p.search(bare[-120:]) for p in (tr._BROKEN_END, hanging, signs)] + [tr._EMPTY_TABLE.search(bare[-300:])]
            assert tr.open_ended(bare) == (any(ends) or _left_open(line)), bare


def _left_open(line):
    depth = {}
    for sign in line:
        if sign in tr._BRACKETS:
            depth[tr._BRACKETS[sign]] = max(0, depth.get(tr._BRACKETS[sign], 0) - 1)
        elif sign in tr._BRACKETS.values():
            depth[sign] = depth.get(sign, 0) + 1
    return any(depth.values())


def test_open_ends():
    for end in ("works with older versions, e.g.", "see [docs](https://code.exam", "```\npip install x", "fixed a crash in the (#4", "one of", "and &am", "so <a hre", "，", "Thanks to @"):
        assert tr.open_ended("Text. " + end), end
    for end in ("Done.", "```\ncode\n```", "(see above)", "「引用。」", "Happy decoding", "https://x.example/a"):
        assert not tr.open_ended("Text. " + end), end


def test_cut_records(spark):
    rng = random.Random(5)
    releases, cut = [], set()
    for i in range(600):
        body = text(rng, 6)
        if i % 12 == 0:
            body, _ = body[: rng.randrange(20, len(body) - 12)].rstrip(" .") + rng.choice(["", "...", " […]"]), cut.add(i)
        releases.append((i, "src", body))
    releases += [(900, "src", None), (901, None, ""), (902, "src", " "), (903, "src", "N/A")]
    df = spark.createDataFrame(releases, "row_id long, source_id string, body string")
    items = spark.createDataFrame([(1, "s", '{"summary": "We rel'), (2, "s", json.dumps({"summary": SENTENCES[0]})), (3, "s", None)], "row_id long, source_id string, raw_json string")
    none = spark.createDataFrame([], "row_id long, model string, summary_zh string")
    found = {(r.tbl, r.row_id) for r in tr.cut_records(none, df, items).collect()}
    assert ("items", 1) in found and ("items", 2) not in found
    hit = {i for t, i in found if t == "releases"}
    assert len(hit & cut) >= 0.9 * len(cut) and len(hit - cut) <= 2 and not hit & {900, 901, 902, 903}
    assert tr.cut_records(none, df.limit(0), items.limit(0)).count() == 0


ZH = ["本研究提出新的方法，並在多項任務上維持穩定表現。", "實驗顯示，移除該模組會使結果下降。", "研究團隊同時公開程式碼與資料，方便後續重現。", "不過，實驗僅涵蓋公開語料，能否推廣仍待驗證。"]


def prose(rng):
    """English of its own, so that another story's text isn't also this one's."""
    word = lambda: "".join(rng.choice("bcdfghlmnprstw") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    return " ".join((" ".join(word() for _ in range(rng.randrange(6, 12)))).capitalize() + "." for _ in range(4))


def pairs(rng, n):
    out = []
    for i in range(n):
        name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
        out.append((f"{name}：以快取改善圖表推理", "".join(rng.choice(ZH) for _ in range(rng.randrange(2, 6))), f"{name}: {prose(rng)[:50]}", prose(rng)))
    return out


def test_classifier_on_held_out_spoilt_pairs():
    """Pairs, parts of refusals and sentences of other languages that training never saw."""
    rng = random.Random(8)
    model = pd_.fit(pairs(rng, 300))
    rows, labels = pd_.synthetic(pairs(rng, 80), seed=99, held=True)
    over = model.scores(rows) - model.limits >= 0
    recall = (over & (labels > 0)).sum(axis=0) / labels.sum(axis=0)
    assert (recall > 0.85).all(), recall
    sound = labels.sum(axis=1) == 0
    assert over[sound].any(axis=1).mean() < 0.03
    # without the weights of n-grams and endings much is lost: they decide
    model.grams[:], model.tails[:] = 0, 0
    bare = model.scores(rows) - model.limits >= 0
    lost = 1 - (bare & (labels > 0)).sum(axis=0) / labels.sum(axis=0)
    assert lost[3] > 0.2 and bare[sound].any(axis=1).mean() + lost.sum() > 0.3, lost


UNSEEN = (
    "這個問題我沒辦法處理，換個題目再試試看吧。", "不好意思，這篇文章我目前無法閱讀，因此不能替您整理重點。", "I'm afraid I'm not able to do this for you.", "Sorry, that is something I can't translate.",
    "Désolé, il m'est impossible de traduire ce document.", "Leider kann ich bei dieser Anfrage nicht helfen.", "申し訳ありませんが、この記事の翻訳はできません。",
)


def test_refusals_nobody_listed():
    rng = random.Random(8)
    model = pd_.fit(pairs(rng, 300))
    known = {s for parts in pd_.PARTS.values() for group in parts for s in group}
    assert not known & set(UNSEEN)
    title = pairs(rng, 1)[0][0]
    rows = pd_.features([title] * len(UNSEEN), list(UNSEEN), np.zeros(len(UNSEEN)), np.zeros(len(UNSEEN)))
    over = model.scores(rows) - model.limits
    assert (over[:, 0] >= 0).sum() >= len(UNSEEN) - 1, over[:, 0]


def test_empty_words():
    for t in (None, "", "  \n", "​", "N/A", "—", "…", "無", "（無）", "[]", '""', "暫無摘要", "null"):
        assert pd_.empty(t), t
    assert not pd_.empty("無限長的上下文") and not pd_.empty("A")


def test_defects_frame(spark):
    rng = random.Random(9)
    made = pairs(rng, 150)
    t = [(i, f"s{i}", a, b, "x") for i, (a, b, _, _) in enumerate(made)]
    t[3] = (3, "s3", t[3][2], None, "x")
    t[4] = (4, "gone", t[4][2], t[4][3], "x")
    t[5] = (5, "s5", t[5][2], made[5][3], "x")
    t[6] = (6, None, t[6][2], "抱歉，我無法協助處理這個請求。", "x")
    stories = [(i, f"s{i}", c, d) for i, (_, _, c, d) in enumerate(made)]
    df = spark.createDataFrame(t, "row_id long, story_id string, title_zh string, summary_zh string, defect string")
    st = spark.createDataFrame(stories, "row_id long, story_id string, title string, summary string")
    got = {r.row_id: r.defect for r in pd_.defects(df, st).collect()}
    assert got.get(3) == "empty" and got.get(5) == "copy" and got.get(6) == "refusal" and len(got) <= 6
    assert pd_.defects(df.limit(0), st).count() == 0
    # a copy of any record of the story counts, not only of the longest
    more = st.unionByName(spark.createDataFrame([(999, "s7", "Another heading", "A short note about something else entirely, in its own words.")], st.schema))
    copied = df.where("row_id <> 7").unionByName(spark.createDataFrame([(7, "s7", t[7][2], "A short note about something else entirely, in its own words.", "x")], df.schema))
    assert {r.row_id: r.defect for r in pd_.defects(copied, more).collect()}.get(7) in ("copy", "refusal")


def test_tokens_of_items_and_stories():
    assert em.address_parts("HTTPS://WWW.axv.example/pdf/2402.00382v2.pdf?ref=digest") == (["#2402.00382"], "")
    assert em.address_parts("https://code.example/loomkit/Mito/releases/tag/v0.10.1/") == (["#loomkit/mito:0.10.1"], "mito 0.10.1")
    assert em.address_parts("https://hub.example/lumenry/Nuho-3B?utm_medium=feed") == (["#lumenry/nuho-3b"], "nuho-3b")
    assert em.address_parts("https://a.example/2025/04/gora-3-9-4-0e4d") == ([], "gora 3.9.4")
    assert em.story_parts("github:loomkit/mito:v0.10.1") == (["#loomkit/mito:0.10.1"], "mito 0.10.1")
    assert em.story_parts("hf:lumenry/nuho-3b") == (["#lumenry/nuho-3b"], "nuho-3b") and em.story_parts("fallback:0e4d12") == ([], "")
    assert em.words(em.plain(r"$\textsc{$\textsc{Kega}$}$-Next: Ａ Lésson v1.2.3")) == ["kega", "next", "lesson", "1.2.3"]
    assert em.variants(em.words(em.plain("Natubek-2 Benchmark")), "natubek") == {"~2"} != em.variants(["natubek"], "natubek")
    assert em.similar("sofenukyar", "sofenukar") > 0.85 and em.similar("abc", "xyz") == 0


NAMES = ["zovimithia", "bekazintus", "fisuhudrex", "vuponuskex", "kahurothum", "desudaskum", "mezorembia", "butubombel"]


def test_matching(spark):
    stories = [(k, f"fallback:{k:04x}{'0' * 12}", f"{n.title()}: A {p} Method for Long Texts", None) for k, n in enumerate(NAMES) for p in ("Stable",)]
    stories.append((50, "arxiv:2401.00001", "Zovimithia-13B: A Stable Method for Long Texts", "2401.00001"))
    items = [
        (1, "Zovimithia: A Stable Method for Long Texts - Velora Blog", "https://x.example/post/1"), (2, "PDF", "https://axv.example/pdf/2401.00001v2.pdf"), (3, "<b>Bekazintus: a stable mehtod for long texts</b>", "https://x.example/post/2"),
        (4, "Fisuhudrex-7B: A Stable Method", "https://x.example/post/3"), (5, None, None), (6, "", ""), (7, "Wholly different words", "https://x.example/post/9"), (8, "zovimithia 13B", "https://x.example/post/4"), (8, "zovimithia 13B", "https://x.example/post/4"),
        (9, "x" * 50_000, "https://x.example/post/5"), (10, "(no title)", "https://x.example/post/2?utm_source=a"),
    ]
    i = spark.createDataFrame(items, "row_id long, title string, url string")
    s = spark.createDataFrame(stories, "row_id long, story_id string, title string, arxiv_id string")
    got = sorted((r.row_id, r.story_id) for r in em.found(i, s).collect())
    zero = lambda k: f"fallback:{k:04x}{'0' * 12}"
    assert got == [(1, zero(0)), (2, "arxiv:2401.00001"), (3, zero(1)), (8, "arxiv:2401.00001"), (10, zero(1))]
    assert em.found(i.limit(0), s).count() == 0 and em.found(i, s.limit(0)).count() == 0
