"""Training-data operators against brute force, exact round trips and the defined results of odd inputs."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireloom.llm import alignment, consensus, encoding, lookalikes, mixing, pairs, residue, responses, splitting, truncation

tokenizers = pytest.importorskip("tokenizers")

WORDS = "stone river letter copper winter garden harbour signal ledger lamp".split()


def text_of(rng, sentences):
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(3, 12))).capitalize() + rng.choice(".!?") for _ in range(sentences))


# --- 1 splitting

def reference_cuts(kinds, limit, overlap):
    """Greedy cuts one after the other."""
    cuts, at = [], 0
    while at < len(kinds):
        reach = min(max(at - overlap, 0) + limit, len(kinds))
        natural = [i for i in range(at + 1, reach + 1) if kinds[i - 1] > 0]
        at = natural[-1] if natural else reach
        cuts.append(at)
    return cuts


def test_pointer_doubling_makes_the_greedy_cuts():
    rng = random.Random(3)
    kinds = [np.array([rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 300))] + [3], np.uint8) for _ in range(60)]
    limits = [rng.randint(5, 40) for _ in kinds]
    overlaps = [rng.randint(0, limit - 1) for limit in limits]
    got = splitting.greedy_cuts(kinds, limits, overlaps)
    assert [g.tolist() for g in got] == [reference_cuts(k, w, o) for k, w, o in zip(kinds, limits, overlaps, strict=True)]


def split(spark, items, limit=40, overlap=8):
    table = spark.createDataFrame([("k", i, t, limit, overlap) for i, t in items], "item_kind string, item_id string, text string, max_tokens int, overlap_tokens int")
    # Columns whose names clash with those of the result must not matter.
    table = table.withColumn("piece_no", F.lit("x")).withColumn("size", F.lit(-1))
    return splitting.split_oversized(table).orderBy("item_id", "piece_no").collect()


def test_pieces_join_to_the_text(spark):
    rng = random.Random(5)
    texts = {f"i{n}": "\n\n".join(text_of(rng, 3) for _ in range(30)) for n in range(5)}
    texts["long"] = " ".join(rng.choices(WORDS, k=5000))
    got = split(spark, texts.items())
    for item, text in texts.items():
        pieces = [p for p in got if p["item_id"] == item]
        words = []
        for p in pieces:
            assert p["text"] == text[p["start_char"] : p["end_char"]] and p["size"] <= 40 and p["n_pieces"] == len(pieces)
            held = p["text"].split()
            assert len(held) == p["n_words"] and p["overlap_words"] == (6 if p["piece_no"] else 0)
            assert words[len(words) - p["overlap_words"] :] == held[: p["overlap_words"]]
            words += held[p["overlap_words"] :]
        assert words == text.split()
        if item != "long":
            assert all(p["cut_at"] != "word" for p in pieces)


def test_odd_items(spark):
    got = split(spark, [("null", None), ("empty", ""), ("blank", " \n "), ("small", "a b"), ("one", "x" * 100_000), ("crlf", "a b.\r\n\r\n" * 40), ("crlf", "a b.\r\n\r\n" * 40)])
    assert {p["item_id"] for p in got} == {"crlf"} and len([p for p in got if p["piece_no"] == 0]) == 2
    assert {p["cut_at"] for p in got} == {"paragraph"}
    assert split(spark, []) == []
    assert len(split(spark, [("a", "w " * 100)], 4, 400)) > 50  # an overlap above the limit still moves on


# --- 2 consensus

def judgements(rng, n_items=400):
    labels, rows, truth = ["a", "b", "c"], [], {}
    skill = {f"good{i}": 0.9 for i in range(3)} | {f"bad{i}": 0.35 for i in range(5)}
    for item in range(n_items):
        truth[item] = rng.choice(labels)
        for agent, p in skill.items():
            if rng.random() < 0.7:
                given = truth[item] if rng.random() < p else rng.choice([x for x in labels if x != truth[item]])
                rows.append((item, agent, given))
    return rows, truth


def raw(spark, rows):
    table = spark.createDataFrame([(i, a, g, n, n) for n, (i, a, g) in enumerate(rows)], "item long, who string, label string, at long, id long")
    return consensus.consensus_of(table.withColumn("agent", F.lit(1)), "label", "item", "who", "at", "id")


def test_consensus_beats_the_majority(spark):
    rows, truth = judgements(random.Random(1))
    items, agents, scale = raw(spark, rows)
    # Nobody can do better than a posterior with the true skills.
    best = {}
    for i, agent, g in rows:
        p = 0.9 if agent.startswith("good") else 0.35
        held = best.setdefault(i, dict.fromkeys("abc", 0.0))
        for x in held:
            held[x] += math.log(p if x == g else (1 - p) / 2)
    ideal = sum(max(sorted(h), key=h.get) == truth[i] for i, h in best.items()) / len(best)
    found = {r["item"]: r["label"] for r in items.collect()}
    right = sum(found[i] == t for i, t in truth.items() if i in found) / len(found)
    votes = {}
    for i, _, g in rows:
        votes.setdefault(i, []).append(g)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()) / len(votes)
    assert right > majority + 0.1 and right > ideal - 0.015
    skill = {r["agent"]: r["reliability"] for r in agents.collect()}
    assert min(v for k, v in skill.items() if k.startswith("good")) > max(v for k, v in skill.items() if k.startswith("bad"))
    # Krippendorff's alpha by its definition over all pairs.
    units = [v for v in votes.values() if len(v) > 1]
    flat = [g for v in units for g in v]
    observed = sum(sum(a != b for n, a in enumerate(v) for m, b in enumerate(v) if n != m) / (len(v) - 1) for v in units) / len(flat)
    everything = [g for v in votes.values() for g in v]
    expected = 1 - sum(everything.count(x) * (everything.count(x) - 1) for x in "abc") / (len(everything) * (len(everything) - 1))
    assert scale.first()["alpha"] == pytest.approx(1 - observed / expected)


def test_joined_fit_agrees_with_the_small_one(spark):
    rows, _ = judgements(random.Random(2), 80)
    rng = random.Random(3)
    table = spark.createDataFrame([(*r, rng.randrange(consensus.LEVELS)) for r in rows], "item long, agent string, label string, level int")
    small, _, _ = consensus.fit_consensus(table)
    joined, _, _ = consensus.fit_consensus(table, max_cells=1)
    a = {r["item"]: r["posterior"] for r in small.collect()}
    b = {r["item"]: r["posterior"] for r in joined.collect()}
    assert a.keys() == b.keys()
    assert all(np.argmax(a[i]) == np.argmax(b[i]) and np.allclose(a[i], b[i], atol=1e-6) for i in a)


def test_confidence_counts_where_it_means_something(spark):
    """Agents right in half of the cases who know when they are right, against ones as good who do not."""
    rng = random.Random(12)
    truth = {i: rng.choice("abc") for i in range(600)}
    rows = []
    for i, t in truth.items():
        for agent in range(4):
            right = rng.random() < 0.5
            sure = rng.uniform(0.75, 1) if right else rng.uniform(0.2, 0.5)
            label = t if right else rng.choice([x for x in "abc" if x != t])
            rows.append((i, f"a{agent}", label, sure * rng.choice([1, 100]), len(rows)))
    table = spark.createDataFrame(rows, "item long, who string, label string, sure double, id long")
    with_it = {r["item"]: r["label"] for r in consensus.consensus_of(table, "label", "item", "who", "id", "id", "sure")[0].collect()}
    without = {r["item"]: r["label"] for r in consensus.consensus_of(table, "label", "item", "who", "id", "id")[0].collect()}
    share = [sum(x[i] == t for i, t in truth.items()) / len(truth) for x in (with_it, without)]
    assert share[0] > 0.9 and share[0] > share[1] + 0.1


def test_later_judgements_win(spark):
    rows = [(1, "x", "Possible omission"), (1, "x", "no-issue"), (1, "y", "NO_ISSUE "), (1, "z", " "), (1, "z", None), (None, "x", "a"), (2, None, "a")]
    items, _, _ = raw(spark, rows)
    got = items.collect()
    assert [(r["item"], r["label"], r["n_agents"], r["observed_agreement"]) for r in got] == [(1, "no_issue", 2, 1.0)]
    empty = raw(spark, [])
    assert empty[0].count() == 0 and empty[1].count() == 0 and empty[2].first()["n_items"] == 0


# --- 3 truncation

def corpus(n=60):
    rng = random.Random(4)
    places, things = ["盐湖镇", "红隼山", "石维克", "韦兰港"], ["账册", "墨石", "潮汐表", "信号灯"]
    def sentence():
        return rng.choice(["{t}在{p}放了{n}年，没有人碰过。", "没有人能解释{p}那种沉默。", "{p}的每一件{t}上都有记号。", "雨停了，但{p}直到早晨都是一片漆黑。"]).format(
            t=rng.choice(things), p=rng.choice(places), n=rng.randint(2, 99))
    return ["".join(sentence() for _ in range(8)) for _ in range(n)]


def cut_rows(spark, texts, **more):
    table = spark.createDataFrame(list(enumerate(texts)), "seq long, body string").withColumn("tail", F.lit(0)).withColumn("dots", F.lit("x"))
    return {r["seq"]: r for r in truncation.detect_cut(table, "seq", "body", **more).collect()}


def test_cuts_are_told_from_open_endings(spark):
    whole = corpus()
    cut = [t[:-9] for t in whole[:5]]
    open_end = [t[:-1] for t in whole[5:10]] + [t + "\n\n——塔文，" + p for t, p in zip(whole[10:30], ["盐湖镇", "红隼山"] * 10, strict=True)]
    got = cut_rows(spark, whole + cut + open_end)
    assert all(got[len(whole) + i]["cut"] for i in range(5))
    assert not any(got[len(whole) + 5 + i]["cut"] for i in range(len(open_end)))
    assert all(got[len(whole) + i]["evidence"] == "copy" for i in range(5))  # its whole text is there
    alone = cut_rows(spark, whole[5:] + [whole[0][:-9]])
    assert alone[len(whole) - 5]["cut"] and alone[len(whole) - 5]["evidence"] == "ending"


def test_odd_texts_are_no_cuts(spark):
    assert cut_rows(spark, []) == {}
    got = cut_rows(spark, [None, "", " ", "null", "```\n```", "译文：", "——", "好。", "好！”"])
    assert got == {}
    got = cut_rows(spark, [*corpus(), corpus()[0][:10] + "�", "长" * 50_000 + "。"])
    assert got[60]["evidence"] == "character"


def test_hot_buckets_are_compared_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(truncation, "FIRST_PARTS", 1)
    base = corpus(1)[0]
    whole = [base + f"第{n}号。" for n in range(30)]
    got = cut_rows(spark, [*whole, base[:-6]])
    assert got[30]["evidence"] == "copy"


def test_a_copy_that_shows_no_cut_does_not_end_the_search(spark, monkeypatch):
    base = "".join(corpus(3))
    cut = base[:-6]
    inserted = [cut[:at] + "".join(chr(0x5000 + 8 * at + k) for k in range(8)) + cut[at:] for at in range(10, 300, 20)]  # longer, ends at the same place
    table = [*inserted, base, base, cut]
    wide = cut_rows(spark, table)
    assert wide[len(table) - 1]["evidence"] == "copy"
    monkeypatch.setattr(truncation, "FIRST_PARTS", 1)
    got = cut_rows(spark, table)
    assert {k: (r["cut"], r["evidence"]) for k, r in got.items()} == {k: (r["cut"], r["evidence"]) for k, r in wide.items()}


@pytest.mark.parametrize("parts, at_once", [(1, 0), (2, 3), (8, 200_000)])
def test_verdicts_do_not_depend_on_how_copies_are_parted(spark, monkeypatch, parts, at_once):
    monkeypatch.setattr(truncation, "FIRST_PARTS", parts)
    monkeypatch.setattr(truncation, "PAIRS_AT_ONCE", at_once)
    base = "".join(corpus(3))[:-1]
    # Longer texts that share the suspect's beginning and phrase but hold too little of it, and one copy among them.
    others = [base[:300] + chr(0x5000 + n) * (200 + 5 * n) + base[-30:] + "还有更多的话要说。" * n for n in range(1, 9)]
    got = cut_rows(spark, [*others, base + "，没有人回来。", base])
    assert (got[9]["cut"], got[9]["evidence"]) == (True, "copy") and len(got) == 1


def test_copies_are_found_as_by_brute_force(spark):
    """Texts cut anywhere from a fifth on, beside whole copies with changed characters."""
    rng = random.Random(11)
    whole = ["".join(corpus(3 * n + 3)[3 * n : 3 * n + 1 + n % 3]) for n in range(80)]
    changed = ["".join(chr(0x4E00 + rng.randrange(5000)) if rng.random() < 0.02 else c for c in t) for t in whole]
    cut = [t[: rng.randint(len(t) // 5, len(t) - 4)].rstrip("。") for t in whole]
    got = cut_rows(spark, changed + cut)
    plain = truncation._Corpus(changed).strings()
    expected = {
        80 + i for i, c in enumerate(truncation._Corpus(cut).strings()) if any(truncation.ends_early(c, w)[1] for w in plain)
    }
    found = {k for k, r in got.items() if r["evidence"] == "copy"}
    assert found <= expected and len(expected) > 60 and len(found) >= 0.9 * len(expected)


def test_copies_in_wrappers_are_found(spark):
    base = "盐湖镇的账册放了九年，没有人碰过它。红隼山的信号灯到早晨才亮"  # short: the wrapper is more than a fifth of the copy
    copy = "以下是《遥远的岛》第一章的简体中文翻译：\n\n" + base + "起来了。"
    assert responses.unwrap(copy) == base + "起来了。"
    got = cut_rows(spark, [copy, base])
    assert got[1]["evidence"] == "copy"


def test_alignment_of_ends():
    plain = truncation._Corpus([corpus(1)[0]]).strings()[0]
    assert truncation.ends_early(plain[:-12], plain)[1]
    assert not truncation.ends_early(plain, plain)[1]
    assert not truncation.ends_early(plain[:-1], plain)[1]
    assert truncation.ends_early(plain, "完全不同的文字，没有任何共同之处。")[0] < 0.8


# --- 4 pairs

def test_defects(spark):
    source = "The rain stopped, but Saltmere stayed dark until morning. Every tide table carries the mark of Orrel."
    good = "雨停了，但盐湖镇直到早晨都是一片漆黑。"
    cases = {
        1: ("c", good, []), 2: ("c", None, ["empty"]), 3: ("c", "译文：\n", ["empty"]), 4: ("c", "N/A", ["empty"]),
        5: ("c", "抱歉，我无法翻译这段内容。", ["refusal"]), 6: ("c", "I'm sorry, but I can't translate this passage.", ["refusal", "other_language"]),
        7: ("c", "> " + source.upper(), ["copy"]), 8: ("c", "La pluie cessa, mais Saltmere resta sombre jusqu'au matin.", ["other_language"]),
        9: ("c", "“抱歉，这一页我没法替你翻译，”塔文合上账册说。" + good, []), 10: ("gone", None, []), 11: (None, None, []),
        12: ("c", good + "（Ludo Amb", ["truncated"]), 13: ("c", "雨はやんだが、Saltmereは朝まで暗いままだった。", ["other_language"]),
        14: ("c", "塔文回答说，账册的事情自己无法提供帮助。", []), 15: ("n", "Text in English.", ["other_language"]),
    }
    prompts = spark.createDataFrame([("c", source), ("c", source), ("n", None), (None, "x")], "chunk_id string, source_text string").withColumn("seq", F.lit("clash"))
    responses_ = spark.createDataFrame([(k, c, t) for k, (c, t, _) in cases.items()], "seq long, chunk_id string, translated_text string").withColumn("empty", F.lit(9))
    got = {r["seq"]: r["defects"] for r in pairs.broken_pairs(prompts, responses_, "chunk_id", "source_text", "seq", "translated_text").collect()}
    assert got == {k: d for k, (_, _, d) in cases.items() if d}
    assert pairs.broken_pairs(prompts, responses_.where("false"), "chunk_id", "source_text", "seq", "translated_text").count() == 0


def test_every_defect_is_listed(spark):
    sources = {"en": "The rain stopped, but Saltmere stayed dark until morning. Every tide table carries the mark of Orrel.",
               "zh": "雨停了，但盐湖镇直到早晨都是一片漆黑。红隼山的每一件账册上都有记号，没有人能解释那种沉默。", "no": "I'm sorry, but I can't translate this passage for you today."}
    cases = {1: ("en", sources["en"], ["copy", "other_language"]), 2: ("zh", sources["zh"], ["copy"]), 3: ("no", sources["no"], ["refusal", "copy", "other_language"]),
             4: ("zh", "雨停了。", []), 5: ("en", None, ["empty"]), 6: ("gone", sources["zh"], [])}
    prompts = spark.createDataFrame(list(sources.items()), "chunk_id string, source_text string")
    rows = spark.createDataFrame([(k, c, t) for k, (c, t, _) in cases.items()], "seq long, chunk_id string, translated_text string")
    got = {r["seq"]: r["defects"] for r in pairs.broken_pairs(prompts, rows, "chunk_id", "source_text", "seq", "translated_text", every=True).collect()}
    assert got == {k: d for k, (_, _, d) in cases.items() if d}


def test_cuts_that_only_a_copy_shows_are_truncated(spark):
    # Cut where the corpus usually ends a sentence: only the longer delivery tells.
    bodies = corpus()
    whole = bodies[0] + "信号灯亮着。雨停了，盐湖镇一片漆黑，没有人回来。"
    cut = bodies[0] + "信号灯亮着"
    bodies = [whole, cut, *(t + "信号灯亮着。" for t in bodies[1:])]
    rows = spark.createDataFrame([(n, "c", t) for n, t in enumerate(bodies)], "seq long, chunk_id string, translated_text string")
    prompts = spark.createDataFrame([("c", "The rain stopped.")], "chunk_id string, source_text string")
    verdict = {r["seq"]: r["evidence"] for r in truncation.detect_cut(rows, "seq", "translated_text").where("cut").collect()}
    assert verdict == {1: "copy"}
    got = {r["seq"]: r["defects"] for r in pairs.broken_pairs(prompts, rows, "chunk_id", "source_text", "seq", "translated_text").collect()}
    assert got == {1: ["truncated"]}


def test_refusals_of_any_length():
    story = "雨停了，但盐湖镇直到早晨都是一片漆黑。没有人能解释那种沉默。" * 20
    reasons = "这段文字涉及的内容较多，其中一些部分可能归他人所有。" * 40
    assert pairs.refuses("抱歉，我无法翻译这段内容。" + reasons) and pairs.refuses(reasons + "因此我不能提供译文。")
    assert pairs.refuses("I'm sorry, but I can't translate this passage. " + "It may be protected by the rights of others, as far as I know. " * 20)
    assert pairs.refuses("我自己无法翻译这段文字。") and pairs.refuses("Ich kann diesen Text leider nicht übersetzen.")
    assert not pairs.refuses(story + "她说自己无法翻译那封信。" + story) and not pairs.refuses(story + "那封信无法翻译。" + story)
    assert not pairs.refuses("“我不能翻译这封信，”她说。") and not pairs.refuses(story)


def test_wrappers_come_off():
    assert responses.unwrap("以下是《遥远的岛》的简体中文翻译：\n\n正文。") == "正文。"
    assert responses.unwrap("```\n正文。\n```") == "正文。"
    assert responses.unwrap("他说：正文很长，不能去掉。") == "他说：正文很长，不能去掉。"


# --- 5 look-alikes

def brute_form(text):
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text))
    return unicodedata.normalize("NFC", "".join(map(lookalikes.plain_form, text)))


def disguise(rng, text):
    alike = {}
    for line in lookalikes.LOOKALIKES.strip().splitlines():
        plain, _, others = line.rpartition(": ") if not line.startswith("::") else (":", "", line[3:])
        alike[plain] = others.split()
    out = []
    for c in text:
        pick = rng.random()
        if pick < 0.1 and c in alike:
            out.append(rng.choice(alike[c]))
        elif pick < 0.2 and "!" <= c <= "~":
            out.append(chr(ord(c) + 0xFEE0))
        elif pick < 0.25:
            out.append(c + rng.choice("​‌⁠﻿­"))
        elif pick < 0.5 and c == " ":
            out.append(rng.choice("  　"))
        elif pick < 0.5:
            out.append(unicodedata.normalize("NFD", c))
        else:
            out.append(c)
    return "".join(out)


def test_canonical_texts_agree_with_brute_force():
    rng = random.Random(6)
    plain = ["Tavin Marlöw（Élodie）说：第一工人于1923年离开。" * 2, "Café com açúcar e pão, naïve coöperation!", "ﬁne Ⅳ ﬂow ｶﾞｷﾞ"]
    texts = plain + [disguise(rng, t) for t in plain for _ in range(60)] + [""]
    tool = lookalikes.Canonical(["Tavin", "Marlöw", "Café"], {",": "，", "一": "一"})
    out = tool.texts(texts)
    by_brute = {}
    for t, o in zip(texts, out, strict=True):
        assert by_brute.setdefault(brute_form(t), o) == o
    assert len(set(by_brute.values())) == len(by_brute)


def test_trie_bounds():
    trie = lookalikes.LookalikeTrie(["Orrel", "Osric"])
    assert trie.find("Οrr​el") == "Orrel" and trie.find("Orrek") is None and trie.find("Orrek", 1) == "Orrel" and trie.find("Orel", 1) == "Orrel"
    assert trie.find("") is None


def test_pairs_of_look_alikes(spark):
    a = "Tavin Orrel 在盐湖镇的墙上画了一幅潮汐表。"
    rows = [(1, a), (2, a), (3, a.replace("O", "О")), (4, a.replace("。", ".")), (5, "short"), (6, "shоrt"), (7, None), (8, a + "​"), (9, ""), (10, "x" * 100_000)]
    table = spark.createDataFrame(rows, "key long, text string").withColumn("table_name", F.lit("t")).withColumn("form", F.lit(1))
    got = {(r["key_a"], r["key_b"]) for r in lookalikes.lookalike_pairs(table, "table_name", "key", "text").collect()}
    assert got == {(1, 3), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert lookalikes.lookalike_pairs(table.where("false"), "table_name", "key", "text").count() == 0
    forms = lookalikes.canonical_texts(table, ["key"], "text", *lookalikes.learn_spellings(table.select("text"))).collect()
    assert {r["key"]: r["canonical"] for r in forms}[7] is None and {r["key"]: r["canonical"] for r in forms}[3] == a


def test_letters_of_other_scripts_and_styles():
    for a, b in ["ヘへ", "ベべ", "ー一", "ιi", "ᴏo", "ꓐB", "ᗷB", "𝐀A", "Ꭵi", "𝟗9", "リり"]:
        assert lookalikes.plain_form(a) == lookalikes.plain_form(b), a + b
    tool = lookalikes.Canonical(["Band"], {})
    assert tool.texts(["𝐁𝐚𝐧𝐝 ꓐand ᗷand", "Hand"]) == ["Band Band Band", "Hand"]


def test_a_hot_class_costs_what_it_gives(spark):
    """Many rows of one string and one variant: as many pairs as rows, none among equals."""
    text = "塔文在盐湖镇的墙上画了一幅潮汐表，没有人碰过。"
    table = spark.range(100_000).select(F.col("id").alias("key"), F.when(F.col("id") == 7, text.replace("。", "｡")).otherwise(text).alias("text"))
    pairs_ = lookalikes.lookalike_pairs(table.withColumn("table_name", F.lit("t")), "table_name", "key", "text")
    got = pairs_.agg(F.count("*"), F.count_if(F.expr("key_a = 7 OR key_b = 7")), F.count_if(F.expr("key_a < key_b"))).first()
    assert tuple(got) == (99_999, 99_999, 99_999)


# --- 6 alignment

def bilingual(rng, n):
    """Documents over an invented lexicon, sentence by sentence, with the true pairs."""
    lexicon = {w: chr(0x4E00 + 37 * i) + chr(0x5E00 + 53 * i) for i, w in enumerate(WORDS + [w[::-1] for w in WORDS])}
    documents, truth = [], set()
    for key in range(n):
        sentences = [rng.sample(sorted(lexicon), rng.randint(4, 9)) for _ in range(rng.randint(3, 8))]
        target = [(i, "".join(lexicon[w] for w in s) + "。") for i, s in enumerate(sentences)]
        if rng.random() < 0.5:
            target.pop(rng.randrange(len(target)))
        if len(target) > 2 and rng.random() < 0.5:
            at = rng.randrange(len(target) - 1)
            target[at], target[at + 1] = target[at + 1], target[at]
        truth |= {(key, i, j) for j, (i, _) in enumerate(target)}
        documents.append((key, " ".join(" ".join(s) + "." for s in sentences), "".join(t for _, t in target)))
    return documents, truth


def test_alignment_finds_the_pairs(spark):
    documents, truth = bilingual(random.Random(8), 300)
    odd = [(900, None, "好。"), (901, "A.", None), (902, " ", "好。"), (903, "", "")]
    table = spark.createDataFrame(documents + odd, "seq long, s string, t string").withColumn("key", F.lit("x")).withColumn("source", F.lit("x"))
    got = {tuple(r)[:3] for r in alignment.align_sentences(table, "seq", "s", "t").collect()}
    right = len(got & truth)
    assert right / len(got) > 0.95 and right / len(truth) > 0.95
    assert alignment.align_sentences(table.where("false"), "seq", "s", "t").count() == 0


def stepwise_lengths(source, target, ratio):
    """The cheapest alignment by length, cell by cell."""
    n, m = len(source), len(target)
    src, tgt = np.concatenate(([0.0], np.cumsum(source))), np.concatenate(([0.0], np.cumsum(target)))
    best, back = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            for di, dj, price in ((1, 1, 0.0), (1, 0, 2.2), (0, 1, 2.2), (2, 1, 1.6), (1, 2, 1.6)):
                if (i - di, j - dj) in best:
                    expected, real = (src[i] - src[i - di]) * ratio, tgt[j] - tgt[j - dj]
                    z = abs(real - expected) / np.sqrt(0.12 * (expected + real + 2) * 2) if di and dj else 0.0
                    cost = best[i - di, j - dj] + price + z
                    if cost < best.get((i, j), math.inf):
                        best[i, j], back[i, j] = cost, (di, dj, z)
    found, i, j = [], n, m
    while i or j:
        di, dj, z = back[i, j]
        i, j = i - di, j - dj
        found += [(i, j, z)] if di == dj == 1 else []
    return found


def test_lengths_are_aligned_as_cell_by_cell():
    rng = np.random.default_rng(5)
    many = []
    for _ in range(40):
        a = rng.integers(10, 90, rng.integers(1, 30)).astype(float)
        b = np.delete(a, rng.integers(0, len(a))) * 0.4 + rng.normal(0, 2, len(a) - 1) if len(a) > 3 else a * 0.4
        got = alignment.align_lengths(a, np.maximum(b, 1), 0.4)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in stepwise_lengths(a, np.maximum(b, 1), 0.4)]
        many.append((a, np.maximum(b, 1)))
    many.append((np.zeros(0), np.array([5.0])))
    together = alignment.align_batch(many, 0.4)
    for (a, b), beads in zip(many, together, strict=True):
        alone = alignment.align_lengths(a, b, 0.4)
        assert [x[:2] for x in beads] == [x[:2] for x in alone] and np.allclose([x[2] for x in beads], [x[2] for x in alone])


def test_paths_by_cells_and_at_once_are_the_same():
    rng = np.random.default_rng(8)
    for n, m in [(1, 1), (1, 6), (6, 1), (5, 9), (30, 24), (60, 80)]:
        for _ in range(6):
            score = np.round(rng.normal(-0.4, 0.7, (n, m)), int(rng.integers(1, 6)))  # few digits give ties
            assert alignment._path_at_once(score) == alignment._path_by_cells(score)


def test_long_documents_are_aligned_in_windows(spark):
    """A document of 3,000 sentences with omissions and swaps, beside short ones, from which the words are learnt."""
    rng = random.Random(18)
    documents, truth = bilingual(rng, 200)
    lexicon = {w: chr(0x4E00 + 37 * i) + chr(0x5E00 + 53 * i) for i, w in enumerate(WORDS + [w[::-1] for w in WORDS])}
    sentences = [rng.sample(sorted(lexicon), rng.randint(4, 9)) for _ in range(3000)]
    target = [(i, "".join(lexicon[w] for w in x) + "。") for i, x in enumerate(sentences) if rng.random() > 0.05]
    for at in rng.sample(range(len(target) - 1), 100):
        target[at], target[at + 1] = target[at + 1], target[at]
    documents.append((777, " ".join(" ".join(x) + "." for x in sentences), "".join(t for _, t in target)))
    truth = {(777, i, j) for j, (i, _) in enumerate(target)}
    table = spark.createDataFrame(documents, "seq long, s string, t string")
    got = {tuple(r)[:3] for r in alignment.align_sentences(table, "seq", "s", "t").where("seq = 777").collect()}
    assert len(got & truth) > 0.95 * len(truth) and len(got & truth) > 0.95 * len(got)


def test_sentences():
    assert alignment.source_sentences("One 1.5 two. Three? Four !\n\nrest") == ["One 1.5 two.", "Three?", "Four !", "rest"]
    assert [s.strip() for s in alignment.target_sentences("“甲。”乙！丙")] == ["“甲。”", "乙！", "丙"]


# --- 7 encoding

@pytest.fixture(scope="module")
def bpe():
    return encoding.ByteBpe(encoding.read_ranks())


def test_ids_are_those_of_the_public_tokenizer(bpe):
    import public_tokenizers as P

    reference = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(9)
    alphabet = "'strvelmdSTx  \n\t\r 　aéß中文のقا9٣½!?.-_<|>🙂​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> it's we'll 'tis", None, "", "a" * 5000, " " * 300, "don't we've I'm you'd they'll 's''s", "字" * 3000]
    flat, counts, widths = bpe.encode(texts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    expected = [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for t, ids, a, b in zip(texts, expected, bounds[:-1], bounds[1:], strict=True):
        assert flat[a:b].tolist() == ids, t
        assert bpe.decode(flat[a:b].tolist()).decode() == (t or "") and widths[a:b].sum() == len((t or "").encode())


def test_own_merging_equals_the_library(bpe):
    own = encoding.ByteBpe(encoding.read_ranks(), native=False)
    texts = ["The price of a copper plate", "盐湖镇的墙上", "naïve 🙂 '''s"]
    assert own.encode(texts)[0].tolist() == bpe.encode(texts)[0].tolist()


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, encoding.SYMBOLS * 2, 5000).astype(np.uint8)
    state, out = encoding.BEGIN, []
    for s in symbols:
        state = encoding.transitions()[s, state]
        out.append(state)
    assert encoding.scan_states(symbols, 17).tolist() == out


def test_encoding_rows(spark, bpe):
    table = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b")], "id long, body string").withColumn("ids", F.lit("clash"))
    got = encoding.encode_texts(table, "id", "body", offsets=True).collect()
    assert sorted((r["id"] or 0, len(r["ids"])) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert next(r for r in got if r["id"] == 1)["byte_starts"] == [0, 1]
    assert encoding.encode_texts(table.where("false"), "id", "body").count() == 0


# --- 8 mixing

def mix(spark, documents, targets, **more):
    docs = spark.createDataFrame(documents, "doc_id long, source string, text string").withColumn("uses", F.lit("x")).withColumn("tokens", F.lit(0))
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return tuple(x.collect() for x in mixing.mix_sources(docs, wanted, **more))


def test_shares_are_reached(spark):
    rng = random.Random(10)
    documents = [(n, rng.choices("abcd", [60, 30, 8, 2])[0], text_of(rng, rng.randint(1, 6))) for n in range(3000)] + [(9001, None, "x"), (9002, "a", None), (9003, "b", ""), (9004, "z", "no target")]
    targets = [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.25, 4), ("d", 0.1, 5), ("gone", 0.05, 2), (None, 0.5, 1)]
    rows, report = mix(spark, documents, targets)
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == set("abcd")
    caps = {s: r for s, _, r in targets}
    assert all(1 <= r["uses"] <= caps[r["source"]] for r in rows)
    shares = {r["source"]: r["actual_share"] for r in report}
    for source, share, _ in targets[:4]:
        assert shares[source] == pytest.approx(share / 0.95, abs=0.01)
    total = sum(r["n_tokens"] * r["uses"] for r in rows)
    assert total == sum(r["used_tokens"] for r in report)
    # The mix is as large as the scarcest source allows.
    have = {r["source"]: r["available_tokens"] for r in report}
    most = min(have[s] * r / (w / 0.95) for s, w, r in targets[:4])
    assert total == pytest.approx(most, rel=0.01)
    again, _ = mix(spark, documents, targets)
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_giant_records_do_not_leave_a_gap(spark):
    documents = [(0, "a", "word " * 5000)] + [(n, "a", "a few words here") for n in range(1, 2000)] + [(n, "b", "some other words") for n in range(3000, 3300)]
    _, report = mix(spark, documents, [("a", 0.5, 1), ("b", 0.5, 1)])
    used = {r["source"]: r["used_tokens"] for r in report}
    assert used["a"] == pytest.approx(used["b"], rel=0.01)


def test_empty_mixes(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0] == []
    assert mix(spark, [(1, "a", "x")], [])[0] == []
    assert mixing.plan_budgets([("a", 0.0, 1, 10), ("b", 1.0, 0, 10)]) == {}
    assert mixing.plan_budgets([("a", 1.0, 3, 10)], 25)["a"] == {"budget": 25, "copies": 2, "rest": 5}
    assert math.isclose(sum(p["budget"] for p in mixing.plan_budgets([("a", 0.1, 1, 70), ("b", 0.9, 9, 70)]).values()), 700, abs_tol=1)


# --- 9 residue

RESIDUE = [
    "Dear {{title}}, thank you.", "Übersetzt von %s im Jahr 1956.", "${isbn}", "© 1923 %(chapter_title)s.", "Chapter 3: @@DATE@@", "<AUTHOR>", "[Your date] was here",
    "_____ (author) wrote it", "XXXX年XX月XX日", "尊敬的<BLURB>：您好！", "Menu\nSign in\n\n404 Not Found\nThe requested chapter was not found on this server.",
    "Please enable JavaScript to view this reader.", "Lorem ipsum dolor sit amet, consectetur.", "xxxx xxxxx xx xxxxxxx. xxxx xxxxx.", "服务器繁忙，请稍后重试。",
    "Marna quisto ocula quisto medium sitra vespio velora. Luntor brevis ipnum cantor.", "The rain stopped in Drumlin.\n\nSample paragraph. Replace this text with your own.",
]
REAL = [
    "In the style sheet a field name stands between double braces, as in `{{title}}`, and is replaced.", "The example prints “Hello, %s” and then the name.",
    "The sign on the door said “Not found here, ask in Lanternhouse”.", "Errata: page 404, line 46: for “gate” read “gait”; page 500: error in the draft.",
    "Rosalba enabled scripts in the reader so that footnotes were numbered; JavaScript took 39 lines.", "The set {0, 1, 2} is printed in braces. [sic] <em>x</em> [Figure 3]",
    "<|endoftext|> is a name of a token, as [MASK] and <pad> are.", "The price rose by 50 percent and 5% more.", "", None, "   ", "Access to the archive was denied to Tavin in 1862.",
]


def test_residue(spark):
    rows = [(n, t, f"s{n % 4}") for n, t in enumerate(RESIDUE + REAL)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("x")).withColumn("n", F.lit("x"))
    got = {r["doc_id"] for r in residue.find_residue(table, "doc_id", "text", "source").where("excluded").collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.find_residue(table.where("false"), "doc_id", "text", "source").count() == 0


def test_filler_of_short_runs_is_found(spark):
    texts = ["xx xx xx", "X x. X x x.", "x_xx_x", "xx “Tavin” xx xx", "The box was six feet tall, and the tax was paid."]
    table = spark.createDataFrame([(n, t, "s") for n, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in residue.find_residue(table, "doc_id", "text", "source").where("excluded").collect()}
    assert got == {0, 1, 2, 3}


def test_placeholders_between_ideographs_are_found():
    for text in ["本书%s由塔文整理。", "本书__PUBLISHER__由塔文整理。", "尊敬的%DATE%：您好！", "本书{0}由塔文整理。", "Dear (enter title), thank you."]:
        assert residue.has_placeholder(text), text
    assert not residue.has_placeholder("价格上涨了50%，又跌了5%。到1910年") and not residue.has_placeholder("(enter)")


def test_recurring_notices_of_any_wording_are_found(spark):
    """Messages that no phrase tells, in four languages: residue where they recur over sources, text where they do not."""
    notices = ["La pagina richiesta non è disponibile. Riprova più tardi.", "Hoppla! Diese Seite ist zurzeit nicht erreichbar, bitte versuchen Sie es nachher.",
               "Oh dear, your browser could not open {n} because the network link broke.", "抱歉，您要看的页面{n}暂时打不开，网络似乎断了。"]
    texts = [x.replace("{n}", str(17 * n)) for n in range(4) for x in notices]
    real = ["La vecchia barca tornava lentamente verso porto prima degli altri pescatori.", "Tavin Orrel, Maren Skarne, Quill Dubrecq, Ludo Ambrosk, Petra Corvane",
            "The traveller was refused; access denied, said the guard.", "Nobody asked for the server of the inn, and your letter never came."]
    rows = [(n, t, f"s{n % 3}") for n, t in enumerate(texts)] + [(100 + n, t, "s0") for n, t in enumerate(real)]
    rows += [(200, "Your browser is not the one that our server likes.", "s0")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in residue.find_residue(table, "doc_id", "text", "source").where("excluded").collect()}
    assert got == set(range(len(texts)))


def test_every_phrase_has_a_hint():
    samples = [t for t in RESIDUE if t and not residue.has_placeholder(t)]
    for text in samples:
        found = any(residue.kind_of(s) for s in text.split("\n"))
        assert not found or any(h in text.lower() for h in residue.HINTS), text


def test_masks_group_messages():
    assert residue.masked("Error 724: the service in Old Vessany failed") == residue.masked("Error 31: the service in Drumlin failed")
