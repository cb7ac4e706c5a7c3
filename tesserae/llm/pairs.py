"""Problem 1: broken prompt and response pairs.

An answer is cut into clauses; a conditional random field tags each as answer, refusal, echo, foreign or
unfinished, and the shares of the answer that the tags cover decide the pair's defect. The field reads the words of
a clause, its end, its overlap with the question and the language asked for. It is fitted on a bounded sample of pairs: rules
label their clauses, and further pairs with planted defects (cut answers, answers to questions in another language,
repeated questions) are made of them. The rules are used nowhere else.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import crf

#: Rows of the weights by feature under "", and by word under each language asked for, where a word's row is what it says in any
#: language and what it says in that one; then the weights and the transitions.
Model = tuple[dict[str, dict[str, int]], np.ndarray, np.ndarray]
LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Pairs of which the field is fitted, at most: those of the smallest hash.
FIT_PAIRS = 8000

# What shows nothing, marks beside the text, labels and stand-ins.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿]")
CITATION = re.compile(r"[\[【(]\s*[Cc]\s*[:.]?\s*\d+\s*[\]】)]")
SIDE_MARK = re.compile(r"(?:\s*(?:※\s*\d+|\(\s*\d+\s*件\s*\)))+\s*$")
LABEL = re.compile(r"(?im)^[\s>*_#-]*(?:question|answer|response|reply|q|a|質問|回答|答え|問|答|frage|antwort)\s*[*_]*\s*:\s*")
STAND_IN = re.compile(r"(?i)^(?:none|null|nil|nan|n/?a|n\.a\.?|empty|undefined|unknown|missing|blank|no answer|no response|not available|not applicable|tbd|tba|todo|to be determined|xxx|なし|無し|空|空白|空欄|未定|未入力|未回答|未記入|該当なし|回答なし|不明)$")
WRAPPER = re.compile(r"(?i)というご質問ですね|についてのご質問ですね|とのことですね|you asked|your question(?: was| is)?|the question(?: was| is)?|ご?質問(?:の内容)?は|お尋ねは|ご質問")
# Words by which seed rules know a refusal, and an offer that follows one.
REFUSAL_SEED = re.compile(
    r"(?i)お?答え(?:する|でき)\w*(?:でき)?(?:ません|かねます)|(?:いたし|わかり|でき|致し|分かり)かねます|判断できません|確認できておりません|確認できませんでした|見当たりません|差し控え|"
    r"(?:手伝い|対応|回答|説明|提供)(?:する)?(?:こと[はが])?(?:でき|致し|いたし)(?:ません|かね)|含まれて(?:い|おり)ません|特定できません|お断り|記載(?:が|は)(?:ない|ありません)|情報(?:が|は)(?:ない|ありません|見つかりません)|"
    r"(?:unable|not able) to (?:answer|help|assist|discuss|provide|comment|determine|say)|(?:can't|cannot|can not|could not|couldn't|won't) (?:help|answer|assist|discuss|provide|comment|determine|find|say|comply)|"
    r"(?:do not|don't) (?:know|have (?:enough|any|access))|not enough (?:evidence|information|context)|no (?:relevant )?(?:information|evidence|answer)\b.*\b(?:found|available)|does(?: not|n't) (?:contain|mention|include|cover|say)|"
    r"decline to|rather not|outside (?:of )?(?:what|my|the scope)|not (?:something )?(?:I am|I'm) able|"
    r"kann (?:diese|ihnen|ich|dazu|das)\b.*\bnicht|keine (?:angabe|information|antwort)|weiß (?:ich )?(?:es )?nicht|답변(?:할|드릴) 수 없|알 수 없|확인할 수 없|je ne (?:peux|sais) pas|no puedo (?:responder|ayudar)|no lo sé"
)
OFFER = re.compile(r"(?i)お試しください|お問い合わせ(?:ください|下さい)|追加していただ|再度確認|ご確認ください|try asking|please (?:contact|ask|try|rephrase)|could you share|share more|let me know|happy to help")
SOFT_NO = re.compile(r"(?i)ません|ない。?$|かねます|控え|\bnot\b|n't\b|\bno\b|\bunable\b|\bdecline|\bcannot\b|\bnicht\b|\bkein")
APOLOGY = re.compile(r"(?i)申し訳|恐れ入り|すみません|残念ながら|提示された資料の範囲|\bsorry\b|\bunfortunately\b|\bapolog|as an? (?:ai|assistant)|leider")
QUOTED = re.compile(r"「[^」]*」|『[^』]*』|\"[^\"\n]*\"|“[^”]*”")
CODE = re.compile(r"`[^`\n]*`")
NAME = re.compile(r"\b\w+(?:[_/.\\:-]\w+)+\b|\b[a-z]+[A-Z]\w*|\b[A-Z]\w*[a-z][A-Z]\w*|\b[A-Z0-9_]{2,}\b")
# Frequent small words by language.
SMALL_WORDS = {
    "en": "the a an of to in is are was and or that this with for from by not be on it as at which has have only when where what who how why does do i you".split(),
    "de": "der die das und ist nicht ein eine einen wird werden mit von zu in dem den des bei nach auf sich durch für sobald oder als auch im sind beträgt".split(),
    "fr": "le la les des est et un une dans par pour que qui de du l' au sont lorsque ensuite selon sur avec pas il elle délai jours".split(),
    "es": "el la los las es y un una en por para que de del se al con no según está llama plazo días vez después".split(),
    "pt": "o a os as é e um uma em por para que de do da se não com está".split(),
    "it": "il lo la gli le è e un una in per che di del della si non con".split(),
}
# Characters of simplified Chinese that Japanese doesn't use, and small words; text without kana is Chinese with them.
CHINESE = re.compile("[这请为负责处设时间实现结调个们给运认检该则没还对从让说话过进远边达带关开问题应传输务员报错误读写类别图书馆]|的|了|是|在|吗|呢")
WORD_LANGUAGES = {w: [k for k, ws in SMALL_WORDS.items() if w in ws] for ws in SMALL_WORDS.values() for w in ws}
ASKED = [
    ("en", re.compile(r"(?i)英語で|\bin english\b|auf englisch")),
    ("ja", re.compile(r"(?i)日本語で|\bin japanese\b|auf japanisch")),
    ("de", re.compile(r"(?i)ドイツ語で|\bin german\b|auf deutsch")),
    ("ko", re.compile(r"(?i)韓国語で|\bin korean\b")),
    ("zh", re.compile(r"(?i)中国語で|\bin chinese\b")),
    ("fr", re.compile(r"(?i)フランス語で|\bin french\b")),
    ("es", re.compile(r"(?i)スペイン語で|\bin spanish\b")),
]
ASKING = re.compile(r"(?i)答え|回答|説明して|返答|お願い|記述|書いて|\banswer|\breply|\brespond|\bwrite|\bantwort")
TERMINATED = re.compile(r"(?:[。!?؟]|(?<!\.)\.)[」』)\"'”’\]*_\s]*$")
BULLET = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+")
SENTENCE = re.compile(r"(?<=[。!?])\s*|(?<=[.!?])\s+|\n+")
FENCE = re.compile(r"(?m)^\s*(?:```|~~~)")
HIDE = ""


def plain(text: str | None) -> str:
    """One character form, without invisible characters."""
    if text and text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n")
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).replace("\r\n", "\n").replace("\r", "\n")


def bare(text: str) -> str:
    """Without citation and side marks at any place."""
    return SIDE_MARK.sub("", CITATION.sub("", text)).strip()


NOT_WORD = re.compile(r"[\W_]+")


def squeezed(text: str) -> str:
    """Letters and digits only, lower case."""
    return NOT_WORD.sub("", text.lower())


def language(text: str) -> str | None:
    """Language of the prose of a clause, or None where code, names and bare words leave no prose."""
    prose = NAME.sub(" ", CODE.sub(" ", text))
    if re.search("[가-힣]", prose):
        return "ko"
    if re.search("[ぁ-ゖァ-ヺ]", prose):
        return "ja"
    if len(re.findall("[一-鿿]", prose)) >= 2:
        return "zh" if CHINESE.search(prose) else "han"
    hits: dict[str, int] = {}
    for word in re.findall(r"[a-zà-öø-ÿß']+", prose.lower()):
        for k in WORD_LANGUAGES.get(word, ()):
            hits[k] = hits.get(k, 0) + 1
    return max(hits, key=lambda k: (hits[k], k == "en")) if hits else None


def expected(question: str) -> str | None:
    """The language asked for, else the question's."""
    if ASKING.search(question):
        for k, pattern in ASKED:
            if pattern.search(question):
                return k
    found = language(question)
    return "ja" if found == "han" else found


def unfinished(text: str) -> bool:
    """Whether the text breaks off before a sentence or a block of code is complete."""
    text = bare(text)
    if not text:
        return False
    fences = re.findall(r"(?m)^\s*(?:```|~~~)", text)
    if len(fences) % 2:
        return True
    last = text.rstrip().split("\n")[-1].strip()
    if re.match(r"^(?:```|~~~)", last):
        return False
    if last.count("`") % 2:
        return True
    if BULLET.match(last):
        return bool(re.search(r"[,、(（:：-]$", last)) or last.count("(") > last.count(")")
    if re.fullmatch(r"`[^`]+`|\|.*\||#+ .*|[\w./\\-]+", last) and not re.search("[ぁ-ゖァ-ヺ一-鿿]", last):
        return False
    return not TERMINATED.search(last)


def clauses(answer: str) -> list[tuple[str, bool]]:
    """Clauses of prose with whether each is code; code spans and fenced blocks are kept whole."""
    out = []
    for i, block in enumerate(re.split(r"(?m)^\s*(?:```|~~~)[^\n]*$", answer)):
        if i % 2:
            out += [(block.strip(), True)] if block.strip() else []
            continue
        spans = CODE.findall(block)
        hidden = CODE.sub(HIDE, block)
        for part in SENTENCE.split(hidden):
            if part and part.strip():
                while HIDE in part:
                    part = part.replace(HIDE, spans.pop(0), 1)
                out.append((part.strip(), False))
    return out


def bigrams(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)} or {text}


TOKEN = re.compile(r"[^\W_]*(?:[_/.\\:-]+\w+)+|[^\W\d_]+(?:'[a-z]+)?")
WORD, QUOTE = re.compile(r"[^\W_]"), re.compile("[「『\"“]")
KANA, HAN, HANGUL = re.compile("[ぁ-ゖァ-ヺ]"), re.compile("[一-鿿]"), re.compile("[가-힣]")
EAST = re.compile("[ぁ-ヿ一-鿿々]+")
END_CLASS = (
    ("stop", re.compile(r"[。!?؟]$|(?<!\.)\.$")), ("comma", re.compile(r"[,、;；]$")), ("open", re.compile(r"[(（:：\[「-]$")), ("close", re.compile(r"[)）\]」』\"']$")),
    ("kana", re.compile("[ぁ-ヿ]$")), ("han", re.compile("[一-鿿]$")), ("letter", re.compile(r"[^\W\d_]$")), ("digit", re.compile(r"\d$")),
)
NAMED_LINE = re.compile(r"`[^`]+`|\|.*\||#+ .*|[\w./\\-]+")


@lru_cache(maxsize=4096)
def asked(question: str) -> tuple[str, frozenset[str], str, frozenset[str]]:
    """The language an answer should have, and the question's pairs of characters, letters and words."""
    q = plain(question)
    own = squeezed(q)
    return expected(q) or "none", frozenset(bigrams(own)), own, frozenset(units(CODE.sub(" ", q)))


def units(masked: str) -> list[str]:
    """Words of a clause, names and capitals aside; runs without spaces as single characters and pairs."""
    out = []
    for token in TOKEN.findall(masked):
        if EAST.match(token):
            for run in EAST.findall(token):
                out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        elif token.isalpha() or "'" in token:
            low = token.lower()
            if token[0] + low[1:] == token:
                out.append(low)
    return out


def ending(answer: str, closed: bool) -> str:
    """How the answer ends: whether code is open, whether its last line is an item, a name or code, and the class of its last character."""
    if not closed:
        return "open code"
    last = answer.rstrip().rsplit("\n", 1)[-1].strip()
    if last.startswith(("```", "~~~")):
        return "closed code"
    bare_end = last.rstrip("」』)\"'”’]*_ ")
    kind = next((name for name, pattern in END_CLASS if pattern.search(bare_end or last)), "mark")
    named = bool(NAMED_LINE.fullmatch(last)) and not EAST.search(last)
    return f"{kind} tick={last.count('`') % 2} item={bool(BULLET.match(last))} named={named} bracket={last.count('(') > last.count(')')}"


def analyse(question: str, answer: str | None) -> tuple[list[str], list[bool], list[tuple[list[str], set[str]]], list[int]]:
    """Clauses of an answer, which of them are code, their features and words that the question hasn't, and the letters of prose in each.

    Marks, labels, empty code blocks and stand-ins for missing values are no clauses.
    """
    want, q_grams, q_own, q_words = asked(question)
    text = bare(LABEL.sub("", bare(plain(answer)) + "\n"))
    closed = len(FENCE.findall(text)) % 2 == 0
    found = [(p, c) for p, c in clauses(text) if WORD.search(p)]
    if len(found) == 1 and len(found[0][0]) < 40 and STAND_IN.match(re.sub(r"^[\W_]+|[\W_]+$", "", found[0][0])):
        found = []
    rows, prose = [], []
    for i, (part, code) in enumerate(found):
        names = ["bias", "code" if code else "text", "only" if len(found) == 1 else "first" if i == 0 else "later"]
        masked = "" if code else CODE.sub(" ", part) if "`" in part else part
        unquoted = QUOTED.sub(" ", masked) if QUOTE.search(masked) else masked
        words = units(unquoted if unquoted is masked or WORD.search(unquoted) else masked)
        script = "kana" if KANA.search(masked) else "hangul" if HANGUL.search(masked) else "han" if HAN.search(masked) else "latin" if words else "none"
        names += [script, f"{want}|{script}"]
        wrapped = WRAPPER.search(part)
        own = squeezed(WRAPPER.sub("", part) if wrapped else part)
        grams = bigrams(own)
        echo = len(grams & q_grams) / len(grams) if own else 1.0
        inside = "whole" if own and own in q_own else "extra"
        names += [f"echo {int(echo * 10)} {inside} {min(len(own) // 6, 2)}", "wrapper" if wrapped else "no wrapper"]
        if i == len(found) - 1:
            end = ending(text, closed)
            names += ["last", "end " + end]
        else:
            names.append("inner")
        rows.append((names, set(words) - q_words))
        prose.append(sum(map(len, words)))
    return [p for p, _ in found], [c for _, c in found], rows, prose


def labels(question: str, answer: str) -> list[int]:
    """Labels that rules give the clauses of an answer, for fitting only."""
    parts, code, _, _ = analyse(question, answer)
    text = bare(LABEL.sub("", bare(plain(answer)) + "\n"))
    want, _, q_own, _ = asked(question)
    out: list[int] = []
    for i, part in enumerate(parts):
        unquoted = CODE.sub(" ", QUOTED.sub(" ", part))
        own = squeezed(WRAPPER.sub("", part))
        same = not own or own in q_own and (len(own) >= 6 or own == q_own) or bool(q_own) and not own.replace(q_own, "")
        found = None if code[i] else language(unquoted if re.search(r"\w", unquoted) else part)
        other = found is not None and want != "none" and found != want and not (found == "han" and want in ("ja", "zh"))
        if same:
            out.append(ECHO)
        elif not code[i] and (REFUSAL_SEED.search(unquoted) or OFFER.search(unquoted) and (not out or out[-1] == REFUSAL)):
            out.append(REFUSAL)
        elif other:
            out.append(FOREIGN)
        else:
            out.append(UNFINISHED if i == len(parts) - 1 and unfinished(text) else ANSWER)
    return out


def examples(rows: list[tuple[str, str, list[int]]]) -> Iterator[tuple[str, str, list[int]]]:
    """The labelled pairs, and pairs with planted defects: repeated questions, cut answers, and answers to questions in another language."""
    sound = [(q, a) for q, a, tags in rows if not any(tags)]
    yield from rows
    for i, (question, _, _) in enumerate(rows):
        if i % 6 == 0:
            copy = (f"{question} [C:1]", f"Q: {question}", question.upper())[i // 6 % 3]
            yield question, copy, [ECHO] * len(analyse(question, copy)[0])
    for i, (question, answer) in enumerate(sound):
        if i % 3 == 0:
            cut = answer[: max(len(answer) * (30 + i * 7 % 60) // 100, 1)]
            tags = labels(question, cut)
            if tags and unfinished(cut):
                yield question, cut, [*tags[:-1], UNFINISHED]
        elif i % 3 == 1:
            other = next((q for q, _ in sound[i + 1 : i + 40] if asked(q)[0] != asked(question)[0]), None)
            if other:
                yield other, answer, labels(other, answer)


def known_ids(clause: tuple[list[str], set[str]], want: str, vocabulary: dict[str, dict[str, int]]) -> list[int]:
    """Rows of the weights that a clause's features and words stand for; unknown ones have none."""
    names, words = vocabulary.get("", {}), vocabulary.get(want) or vocabulary.get("none", {})
    return [names[f] for f in clause[0] if f in names] + [words[u] for u in clause[1] if u in words]


def defect(question: str, answer: str | None, model: Model) -> str | None:
    """The pair's first defect, from the share of the answer that each tag covers, or None. Exact checks confirm copies and cut endings."""
    parts, _, rows, prose = analyse(question, answer)
    if not parts:
        return "empty"
    vocabulary, w, tr = model
    want = asked(question)[0]
    tags = crf.decode([known_ids(clause, want, vocabulary) for clause in rows], w, tr)
    cover = [0] * len(LABELS)
    foreign = 0
    for part, tag, letters in zip(parts, tags, prose, strict=True):
        cover[tag] += max(len(part), 1)
        foreign += letters if tag == FOREIGN else 0
    total = sum(cover)
    if cover[ECHO] > 0.9 * total and copies(question, answer):
        return "copy"
    if cover[REFUSAL] > 0 and cover[REFUSAL] + cover[ECHO] == total:
        return "refusal"
    if foreign > 0.5 * sum(prose):
        return "language"
    return "truncated" if tags[-1] == UNFINISHED and unfinished(plain(answer)) else None


def copies(question: str, answer: str) -> bool:
    """Exact check of an echo: nothing is left of the answer without the question."""
    q = squeezed(plain(question))
    rest = squeezed(WRAPPER.sub("", bare(LABEL.sub("", plain(answer)))))
    return bool(q) and (q in rest and len(rest.replace(q, "")) <= 2 or len(rest) > 0.9 * len(q) and rest in q)


def question_pairs(eval_sessions: DataFrame, query_results: DataFrame) -> DataFrame:
    """Pairs ``origin, session_id, turn_id, result_id, question, answer``.

    A turn stored twice counts once (the lower question, then answer, in text order). Turns without a
    question and results without a turn are no pairs. A turn's question is one row of the join, so where one session holds a
    third of the results, adaptive execution splits those among tasks by their size.
    """
    turns = eval_sessions.where("session_id is not null").select("session_id", F.explode("turns").alias("t")).where("t.turn_id is not null and t.question is not null")
    turns = turns.select("session_id", F.col("t.turn_id").alias("turn_id"), F.struct(F.col("t.question").alias("question"), F.col("t.reference_answer").alias("answer")).alias("pair"))
    turns = turns.groupBy("session_id", "turn_id").agg(F.min("pair").alias("pair")).select("session_id", "turn_id", "pair.question", "pair.answer")
    own = turns.select(F.lit("eval").alias("origin"), "session_id", "turn_id", F.lit(0).cast("bigint").alias("result_id"), "question", "answer")
    given = query_results.select("session_id", "turn_id", "result_id", "answer")
    results = given.join(turns.select("session_id", "turn_id", "question"), ["session_id", "turn_id"])
    return own.unionByName(results.select(F.lit("result").alias("origin"), "session_id", "turn_id", "result_id", "question", "answer"))


def labelled(pairs: DataFrame, most: int = FIT_PAIRS) -> DataFrame:
    """``question, answer, h, tags`` of the ``most`` pairs of smallest hash, every fourth of those without a defect; all that the field is fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [labels(q, a) for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.list_(pa.int32()))], names=["question", "answer", "h", "tags"])

    sample = pairs.where("answer is not null").select("question", "answer", F.xxhash64("origin", "session_id", "turn_id", "result_id").alias("h"))
    sample = sample.orderBy("h", "question", "answer").limit(most).repartition(16, "h")
    told = sample.mapInArrow(run, "question string, answer string, h bigint, tags array<int>").where("size(tags) > 0")
    return told.where(F.exists("tags", lambda t: t > 0) | (F.pmod("h", F.lit(4)) == 0)).select("question", "answer", "h", "tags")


def fit(pairs: DataFrame, most: int = FIT_PAIRS) -> Model:
    """Fit the field on the labelled sample; the driver sees no other pairs. Features seen once are left out."""
    rows = [(r.question, r.answer, list(r.tags)) for r in sorted(labelled(pairs, most).collect(), key=lambda r: (r.h, r.question, r.answer))]
    known = [(asked(q)[0], analyse(q, a)[2], tags) for q, a, tags in examples(rows) if tags]
    names = [[[*own, *(f"word {u}" for u in words), *(f"word {want} {u}" for u in words)] for own, words in clauses_] for want, clauses_, _ in known]
    seen = Counter(f for clauses_ in names for clause in clauses_ for f in clause)
    rows_of = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    if not rows_of:
        return {}, np.zeros((0, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    ids = [[[rows_of[f] for f in clause if f in rows_of] for clause in clauses_] for clauses_ in names]
    # Words speak for or against refusals, echoes and foreign prose; what an answer says, and where it was cut, can be any words.
    free = np.array([[not f.startswith("word ") or k in (REFUSAL, ECHO, FOREIGN) for k in range(len(LABELS))] for f in rows_of])
    w, tr = crf.fit(ids, [tags for *_, tags in known], free)
    vocabulary: dict[str, dict[str, int]] = {"": {f: i for f, i in rows_of.items() if not f.startswith("word ")}}
    table = [w]
    words = {f.split(" ")[-1] for f in rows_of if f.startswith("word ")}
    at = len(w)
    for want in sorted({"none", *(want for want, *_ in known)}):
        both = [(u, [rows_of[f] for f in (f"word {u}", f"word {want} {u}") if f in rows_of]) for u in sorted(words)]
        both = [(u, own) for u, own in both if own]
        vocabulary[want] = {u: at + i for i, (u, _) in enumerate(both)}
        table.append(np.array([w[own].sum(axis=0) for _, own in both]).reshape(-1, len(LABELS)))
        at += len(both)
    return vocabulary, np.concatenate(table), tr


def defects(pairs: DataFrame, model: Model) -> DataFrame:
    """Defective pairs ``origin, session_id, turn_id, result_id, defect``; equal rows come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(q, a, model) for q, a in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=["origin", "session_id", "turn_id", "result_id", "defect"])

    columns = ["origin", "session_id", "turn_id", "result_id", "question", "answer"]
    tagged = pairs.select(*columns).mapInArrow(run, "origin string, session_id string, turn_id int, result_id bigint, defect string")
    return tagged.where("defect is not null").distinct()
