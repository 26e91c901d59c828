"""Problem 4: defective question and answer pairs.

An answer is split into clauses, each of which a conditional random field tags as answer, refusal, echo,
foreign or unfinished; the shares of words under each tag make the defect of the pair. The field is fitted on
a bounded sample of the pairs themselves, tagged by labelling rules, and then tags every pair. The words of each
language, which tell foreign and cut-off words, are counted over all pairs.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import compress, islice
from operator import itemgetter, or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.crf import ChainCRF
from quillmill.llm.textnorm import fold_text
from quillmill.session import cut_lineage

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
HASHED = 1 << 13

#: Words of questions and running text by language, accents kept. (fixed values)
ENGLISH = set("the of and was in for to is it by that which had with were people near they many at from an after before this so but who did when what how why name explain where does whose as on not his her he she its into under while".split())
VIETNAMESE = set("của và là năm có này cho ở người đã trong những được không một các với để nhiều họ trước sau mà từ về bên tại theo khi nên nhưng bởi tuy ai gì nào sao hãy thì lại vì làm biết vai trò đâu".split())
#: Folded Vietnamese words that no English word equals. (fixed values)
VIETNAMESE_BARE = set("cua va nguoi duoc khong cac voi nhieu truoc nhung boi tuy gi nao hay thi lai vi lam biet vai tro khi cho da la".split())
#: Phrases that decline to answer or say that the sources hold no answer. (fixed values)
REFUSALS = [
    r"\b(?:i|we) (?:cannot|can't|can not|could not|couldn't|am unable|are unable|am not able|must decline|have to decline|won't|will not)\b",
    r"\b(?:i|we) (?:do not|don't|did not|didn't) (?:know|have (?:enough|any|the|sufficient)|find|see any)\b",
    r"\b(?:unable|not able) to (?:help|answer|determine|assist|provide|find)\b",
    r"\bnot enough (?:information|context|data|evidence)\b|\binsufficient (?:information|context|data|evidence)\b",
    r"\bno (?:relevant |further |such |specific )?(?:records?|information|data|details?|results?|answer|evidence)\b.{0,30}\b(?:found|available|provided|given|about|regarding|in the|for this)\b",
    r"\b(?:data|dataset|passages?|context|chunks?|documents?|reports?|sources?|text|materials?)\b.{0,20}\b(?:do not|does not|don't|doesn't|did not) (?:mention|contain|provide|include|say|state|specify|answer)\b",
    r"\b(?:data|dataset|passages?|context|chunks?|documents?|reports?|sources?|text|materials?)\b.{0,20}\b(?:contains?|says?|mentions?|gives?|provides?) (?:nothing|no)\b",
    r"\bcannot be (?:answered|determined|found|verified)\b|\bas an? (?:ai|artificial|language)\b|\bdecline to answer\b",
    r"\bkhông tìm thấy (?:câu trả lời|thông tin|đủ|dữ liệu|bằng chứng)",
    r"\bkhông có (?:đủ )?(?:thông tin|dữ liệu|dữ kiện|câu trả lời)\b|\bchưa có (?:thông tin|dữ liệu)",
    r"\bkhông đủ (?:dữ kiện|thông tin|dữ liệu|cơ sở|căn cứ|ngữ cảnh)",
    r"\b(?:tôi|mình|chúng tôi) (?:không|chẳng|chưa) (?:biết|thể|rõ|tìm|có)\b|\b(?:tôi|chúng tôi) (?:xin )?(?:phép )?từ chối\b",
    r"\bkhông thể (?:trả lời|xác định|cung cấp|giúp|kết luận)",
    r"\b(?:ngữ cảnh|tài liệu|dữ liệu|đoạn trích|văn bản|nguồn)\b.{0,20}\bkhông (?:đề cập|chứa|nhắc|cung cấp|nói|nêu)",
    r"\btừ chối trả lời",
]
#: Openings and closings that go with a refusal but are none alone. (fixed values)
AROUND = [
    r"^(?:i'm |i am |we're |we are )?(?:sorry|afraid|unfortunately)\b", r"^as an? assistant\b", r"^based on the (?:provided|given|available)\b",
    r"^(?:xin lỗi|rất tiếc|thật tiếc)\b", r"^dựa trên (?:dữ liệu|ngữ cảnh|thông tin)\b", r"\bplease (?:consult|check|provide|refer)\b",
    r"\badditional (?:sources|information|context)\b.{0,30}\brequired\b", r"\banything else\b", r"\bvui lòng (?:tham khảo|cung cấp|kiểm tra)",
    r"\bbạn có muốn hỏi\b", r"\bcần thêm (?:tài liệu|thông tin|ngữ cảnh)\b", r"\bwill not speculate\b",
]
#: A contrast that brings the answer after a gap is admitted. (fixed values)
CONTRAST = [r"\b(?:yet|but|however|although|though) (?:they|it|he|she|the|we know)\b.{0,25}\b(?:states?|says?|records?|names?|tells?|was|were|built|show)\b", r"\bnhưng (?:ghi|chép|nói|cho biết|kể|có ghi)\b"]
#: Words that cannot end a finished answer, by language. (fixed values)
DANGLING = {
    "en": set("the a an of to in on at by for with from and or but nor so as such than that which who whose whom because since while although though when where if is are was were be been being has have had do does did not into under over between near after before during about against through without within upon per its his her their our my your this these those it they he she we i year".split()),
    "vi": set("và hoặc nhưng mà của cho với từ trong tại ở bởi vì do nên là được bị đã sẽ đang các những một để khi nếu thì vào trên dưới theo như cũng còn rằng năm này triều".split()),
}
#: Folded answers that stand for nothing. (fixed values)
_NOTHING = {"none", "null", "nan", "na", "n a", "nil", "undefined", "empty", "no answer", "answer", "tra loi", "response", "reply"}

_NO_WIDTH = re.compile("[\u200b-\u200f\u00ad\u2060\ufeff]")
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S | re.I)
_CITE = re.compile(r"\[(?:Data|Sources?|Reports?)\b[^\]]*\]|\((?:Data|Sources?): [^)]*\)")
_LABEL = re.compile(r"^\W*(?:answer|response|reply|trả lời|đáp|đáp án|câu trả lời)\W*:[*_\s]*", re.I)
_ASKED = re.compile(r"^\W*(?:question|q|you asked|the question is|câu hỏi|bạn hỏi|hỏi)\s*:[*_\s]*", re.I)
_QUOTED = re.compile(r"[“\"«‘](?:[^”\"»’]|(?<=\w)’(?=\w))*[”\"»’]")
#: A stop with what closes after it and space, or line ends; a set of characters comes first, so that all others are passed over fast.
_SPLIT = re.compile(r"[.!?…。！？\n](?:(?<=\n)\n*|(?<!\n)([”\"»’)\]*]*\s+))")
_FINISHED = re.compile(r"(?:[.!?。！？]|v\.v\.{3}|etc\.{3})[”\"»’)\]*_]*$")
#: Dots that break an answer off; a word before them tells nothing of an end.
_DOTS = re.compile(r"(?<!v\.v)(?<!etc)(?:\.{3}|…)[”\"»’)\]*_\s]*$")
_WHOLE = re.compile(r"^[“\"«‘]([^“\"«‘”»’]{12,}(?:[“‘][^”’]*[”’][^“\"«‘”»’]*)*)[”\"»’][.!?…]?$")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STACKED = re.compile("(?=[^\\W\\d_])[\u0300-\U0010ffff]")  # letters with a second mark, as Vietnamese has
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿Ѐ-ӿ؀-ۿऀ-ॿ]")
_REFUSAL = re.compile("|".join(REFUSALS))
_AROUND = re.compile("|".join(AROUND))
_CONTRAST = re.compile("|".join(CONTRAST))
_TOKENS = re.compile(r"\w+")
_TOKEN = re.compile(r"\w")
_LOOSE = re.compile(r"[\w']+")
#: Of a text turned round: its last word, if only marks follow, and its last word or mark.
_LAST_WORD = re.compile(r"\W*([^\W\d_]+)")
_LAST_TOKEN = re.compile(r"\s*([^\W\d_]+|\S)")
_OPENED = re.compile(r"[(\[“«‘,;:\-–]\W*$|\[[^\]]*$")
_MARKED = re.compile(r"\b(?:không|tôi|rất|xin|dựa|câu|thông|tài|bạn)\b")
_ABBR = re.compile(r"\.\s(?:" + "|".join(rf"(?<=\b{w}\.\s)" for w in "St Mt Dr Mr Mrs No vol feat c ca tr tp".split()) + ")", re.I)

#: Words of which a clause needs one to match the patterns above. (fixed values)
_REFUSAL_WORDS = frozenset("cannot can't can couldn't could unable not don't doesn't didn't do does did won't no nothing decline insufficient ai artificial language không chẳng chưa từ".split())
_AROUND_WORDS = frozenset("sorry afraid unfortunately assistant based xin rất thật dựa please additional anything vui bạn cần speculate".split())
_DECLINING_WORDS = _REFUSAL_WORDS | _AROUND_WORDS


def language(text: str) -> str | None:
    """en or vi by function words; None where neither shows. Vietnamese without accents counts as Vietnamese."""
    low = text.lower()
    words = _WORDS.findall(low)
    en, vi = sum(map(ENGLISH.__contains__, words)), sum(map(VIETNAMESE.__contains__, words))
    if not vi or not _STACKED.search(low):
        vi = max(vi, sum(map(VIETNAMESE_BARE.__contains__, words)))
    return None if en == vi else "en" if en > vi else "vi"


def _uncited(text: str) -> str:
    return _CITE.sub(" ", text) if "[" in text or "(" in text else text


def said(answer: str | None) -> str:
    """What an answer says: without thinking blocks, labels, citations, marks and words for nothing; '' if it says nothing."""
    text = unicodedata.normalize("NFC", answer or "")
    text = _THINK.sub(" ", text) if "<" in text else text
    text = (text if text.isascii() or text.isprintable() else _NO_WIDTH.sub("", text)).strip()
    label = _LABEL.match(text) if ":" in text else None
    text = text[label.end() :] if label else text
    bare = _uncited(text)
    words = [m.group() for m in islice(_TOKENS.finditer(bare), 3)]
    if not words or (len(words) < 3 and " ".join(_TOKENS.findall(fold_text(" ".join(words)))) in _NOTHING):
        return ""
    return text.strip()


def _marked(clause: str) -> bool:
    return '"' in clause or not clause.isascii() and ("“" in clause or "«" in clause or "‘" in clause)


def _unquoted(clause: str) -> str:
    """A clause without the titles and sayings it quotes; one that is a quotation as a whole is kept."""
    if not _marked(clause):
        return clause
    whole = _WHOLE.match(clause)
    return _QUOTED.sub(" ", whole[1] if whole else clause)


def clauses(text: str) -> list[str]:
    text = _ABBR.sub("․ ", text)
    out, start = [], 0
    for m in _SPLIT.finditer(text):
        out.append(text[start : m.start() if m[1] is None else m.start() + 1])
        start = m.end()
    out = [_uncited(c).replace("․", ".").strip() for c in [*out, text[start:]]]
    return [c for c in out if c and (c[0].isalnum() or _TOKEN.search(c) or c in ("(", "“", "-", "**"))]


def _declines(low: str, loose: Iterable[str]) -> tuple[bool, bool]:
    """Whether a lower-case clause with straight apostrophes declines, and whether it goes with a refusal; ``loose`` are its words."""
    if _DECLINING_WORDS.isdisjoint(loose):
        return False, False
    return (
        not _REFUSAL_WORDS.isdisjoint(loose) and bool(_REFUSAL.search(low)),
        not _AROUND_WORDS.isdisjoint(loose) and bool(_AROUND.search(low)),
    )


#: Words with less than this share of all counted words are left out, so a million words of each kind are kept at most.
WORD_SHARE = 1e-6
#: The same for words of clauses that decline, which count from the first time on.
DECLINED_SHARE = 1e-4
#: Kinds of word counts, each by language: clauses told by function words, declining ones, clauses before the last, last words of these.
COUNTED = ["en", "vi", "declined_en", "declined_vi", "inner_en", "inner_vi", "ended_en", "ended_vi"]
#: Words that stand so often in whole clauses, and of which no more than this share ends one, cannot end an answer.
OPEN_COUNT, OPEN_SHARE = 20, 0.005


def word_lists(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """Lower-case words of question and answer pairs by kind of count, the language of a clause told by its function words.

    The last word of an answer that doesn't end with a stop may be cut off and is left out.
    """
    out: dict[str, list[str]] = {k: [] for k in COUNTED}
    for question, answer in pairs:
        parts = clauses(said(answer))
        for i, c in enumerate([question, *parts]):
            last = i == len(parts)
            run = list(filter(str.islower, _WORDS.findall(c)))
            words = list(filter(str.islower, _WORDS.findall(_unquoted(c)))) if _marked(c) else run
            if i and last and words and c.endswith(words[-1]):
                words.pop()
            en, vi = sum(map(ENGLISH.__contains__, words)), sum(map(VIETNAMESE.__contains__, words))
            if i and not last and en != vi:
                tongue = "en" if en > vi else "vi"
                out["inner_" + tongue] += run
                end = _LAST_WORD.match(c[::-1])
                if end and end[1].islower():
                    out["ended_" + tongue].append(end[1][::-1])
            if max(en, vi) >= 2 and min(en, vi) == 0 and max(en, vi) >= 0.12 * len(words):
                out["en" if en else "vi"] += words
                continue
            low = c.lower()
            if any(_declines(low, _LOOSE.findall(low.replace("’", "'")))):
                out["declined_en" if en >= vi and c.isascii() or not vi and not _MARKED.search(low) else "declined_vi"] += words
    return out


def vocabulary(rows: DataFrame, flush: int = 500_000) -> Vocabulary:
    """Vocabulary of all pairs in columns ``q, a``: each task sends its counts by word, the driver gets words above a share."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {k: Counter() for k in COUNTED}

        def sums() -> pd.DataFrame:
            words = list(set().union(*counts.values()))
            out = pd.DataFrame({"word": words, **{k: np.array([c[w] for w in words], dtype=np.int64) for k, c in counts.items()}})
            for c in counts.values():
                c.clear()
            return out

        for pdf in batches:
            for k, words in word_lists(zip(pdf.q, pdf.a)).items():
                counts[k].update(words)
            if sum(map(len, counts.values())) > flush:
                yield sums()
        if any(counts.values()):
            yield sums()

    shares = rows.mapInPandas(count, ", ".join(["word string", *[f"{k} long" for k in COUNTED]]))
    counts = cut_lineage(shares.groupBy("word").agg(*[F.sum(k).alias(k) for k in COUNTED]))
    total = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in COUNTED]).first()
    least = {k: max(1.0, total[k] * (DECLINED_SHARE if k.startswith("declined") else WORD_SHARE)) for k in COUNTED}
    kept = counts.filter(reduce(or_, [F.col(k) >= least[k] for k in COUNTED])).toPandas()
    return Vocabulary(kept, least)


class Vocabulary:
    """Words of each language by their counts, one row per word with the columns of ``COUNTED``."""

    def __init__(self, counts: pd.DataFrame, least: dict[str, float]):
        pick = lambda rule: set(counts.word[rule])
        self.known = {}
        for k, other, plain in (("en", "vi", ENGLISH), ("vi", "en", VIETNAMESE)):
            told = (counts[k] >= max(3.0, least[k])) & (counts[k] > 4 * counts[other])
            self.known[k] = pick(told | (counts[f"declined_{k}"] >= least[f"declined_{k}"])) | plain
        self.seen = pick((counts.en >= least["en"]) | (counts.vi >= least["vi"]) | (counts.inner_en >= least["inner_en"]) | (counts.inner_vi >= least["inner_vi"]))
        self.open = {}
        for k in ("en", "vi"):
            often = counts[f"inner_{k}"] >= OPEN_COUNT
            self.open[k] = pick(often & (counts[f"ended_{k}"] <= OPEN_SHARE * counts[f"inner_{k}"])) | (DANGLING[k] - pick(often))

    def foreign_share(self, text: str, lang: str, run: list[str] | None = None) -> tuple[float, int, list[str], list[str]]:
        """Share of the words, but names, that the language does not know, and their number; those words; all words (``run`` if no sign is CJK)."""
        cjk = 0 if text.isascii() else len(_CJK.findall(text))
        if cjk or run is None:
            run = _WORDS.findall(_CJK.sub(" ", text) if cjk else text)
        words = list(filter(str.islower, run))
        n = len(words) + cjk
        known, plain = self.known[lang], ENGLISH if lang == "en" else VIETNAMESE
        share = (n - sum(map(known.__contains__, words))) / n if n else 0.0
        if share >= 0.6 and sum(w.lower() in plain for w in run) >= 0.3 * n:  # unknown words on a frame of known function words
            share = 0.5
        return share, n, words, run


def _facts(question: str, lang: str, parts: list[str], vocab: Vocabulary) -> list[dict]:
    question = unicodedata.normalize("NFC", question)
    q = _TOKENS.findall(question.lower())
    q_low = frozenset(q)
    q = q if question.isascii() else _TOKENS.findall(fold_text(question))
    q_set = frozenset(q)
    out = []
    for i, c in enumerate(parts):
        last = i == len(parts) - 1
        asked_at = _ASKED.match(c) if ":" in c else None
        text = _unquoted(c)
        run = None
        if asked_at or text is not c or "'" in c or "’" in c or "İ" in c or "Σ" in c:
            words = _TOKENS.findall((c[asked_at.end() :] if asked_at else c).lower())
            low = text.lower().replace("’", "'")
            loose = _LOOSE.findall(low)
        else:  # the words of each kind are the same runs of signs, found once
            tokens = _TOKENS.findall(c)
            low, loose = c.lower(), list(map(str.lower, tokens))
            words = loose
            run = list(filter(str.isalpha, tokens))
            if len(run) < len(tokens) and not all(t.isdecimal() for t in tokens if not t.isalpha()):
                run = None
        known, hit = q_low, sum(map(q_low.__contains__, words))
        if words and abs(len(words) - len(q)) <= 4 + len(q) // 4 and hit / len(words) < 0.8:
            if not c.isascii():
                words = _TOKENS.findall(fold_text((c[asked_at.end() :] if asked_at else c).lower()))
            known, hit = q_set, sum(map(q_set.__contains__, words))
        refuses, around = _declines(low.strip(), loose)
        contrast = refuses and bool(_CONTRAST.search(low))
        share, n, small, run = vocab.foreign_share(text, lang, run)
        bullet = bool(_BULLET.match(c))
        c = c.strip()
        if c[-1].isalnum():
            dots, stopped = None, False
        elif c[-1] in ".!?。！？" and not c.endswith("..."):
            dots, stopped = None, True
        else:
            dots = _DOTS.search(c[-12:])
            stopped = not dots and bool(_FINISHED.search(c[-12:]))
        if stopped or not last:
            end, opened, ends_loose = "", False, False
        else:
            rest = c[-80:].rstrip(".…”\"»’)]*_ ") if dots else c[-80:].strip("*_ ")
            tail = _LAST_TOKEN.match(rest[::-1])
            end = tail[1][::-1] if tail else ""
            opened = bool(_OPENED.search(c[-80:])) or c.endswith(" **")
            ends_loose = any(end.lower() in held for held in vocab.open.values()) and end.lower() in vocab.open[language(c[: c.rfind(end)] if end else c) or lang]
        out.append(
            {
                "words": max(1, len(words)),
                "echo": hit / len(words) if words else 0.0,
                "covers": len(known.intersection(words)) / len(known) if hit else 0.0,
                "refuses": refuses and not contrast,
                "around": around,
                "contrast": contrast,
                "foreign": share,
                "plain_words": n,
                "last": last,
                "first": i == 0,
                "stopped": stopped,
                "dangling": ends_loose or opened,
                "prose": len(small) >= 4 and len(run) >= 6,
                "bullet": bullet,
                "rare_end": end.isalpha() and end.islower() and end not in vocab.seen,
                "low": small,
            }
        )
    return out


def _rule(f: dict, before: int | None) -> int:
    """Labelling rule for the sample."""
    if f["echo"] >= 0.85 and f["covers"] >= 0.8:
        return ECHO
    if f["plain_words"] >= 3 and f["foreign"] >= 0.6 and not f["refuses"] and not f["around"]:
        return FOREIGN
    if f["refuses"] or (f["around"] and before == REFUSAL):
        return REFUSAL
    if f["last"] and not f["stopped"] and (f["dangling"] or f["rare_end"] or (f["prose"] and not f["bullet"])):
        return UNFINISHED
    return ANSWER


_FLAGS = itemgetter("refuses", "around", "contrast", "last", "first", "stopped", "dangling", "prose", "bullet", "rare_end")


def _features(f: dict) -> list[int]:
    """Indexes of the active features: told facts first, hashed words behind them."""
    echo, covers, foreign, few = f["echo"], f["covers"], f["foreign"], f["plain_words"] < 3
    on = [0, 1 + min(4, int(echo * 5)), 6 + min(4, int(covers * 5)), 11 + min(4, int(foreign * 5))]
    on += compress(range(16, 26), _FLAGS(f))
    echoes, cut = echo >= 0.85 and covers >= 0.8, f["last"] and not f["stopped"]
    both = [
        f["refuses"] and not f["contrast"], cut and f["dangling"], cut and f["prose"] and not f["bullet"], f["last"] and f["rare_end"],
        foreign >= 0.6 and not few and not f["refuses"] and not f["around"] and not echoes, echoes, few, f["last"] and f["stopped"],
    ]
    on += compress(range(30, 38), both)
    on += sorted(set(map(_HASHED.__getitem__, f["low"])))
    return on


class _Hashes(dict):
    """Features of words met so far, at most 100,000."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = 64 + zlib.crc32(word.encode()) % (HASHED - 64)
        return found


_HASHED = _Hashes()


class PairTagger:
    """The fitted field with its vocabulary."""

    def __init__(self, sample: list[tuple[str, str]], vocab: Vocabulary):
        self.vocab = vocab
        seqs, golds = [], []
        for question, answer in sample:
            facts = self.facts(question, answer)
            if facts:
                gold: list[int] = []
                for f in facts:
                    gold.append(_rule(f, gold[-1] if gold else None))
                seqs.append([_features(f) for f in facts])
                golds.append(gold)
        self.field = ChainCRF(HASHED, 5, np.where(np.arange(HASHED) < 64, 1.0, 0.1)).fit(seqs, golds, epochs=8)

    def facts(self, question: str, answer: str) -> list[dict]:
        return _facts(question, language(question) or "en", clauses(said(answer)), self.vocab)

    def defects(self, pairs: Iterable[tuple[str | None, str | None]], at_once: int = 20_000) -> Iterator[str | None]:
        """The defect of each pair, or None; about ``at_once`` clauses are decoded together."""
        pairs = iter(pairs)
        while True:
            sizes, seqs, held = [], [], 0
            for question, answer in pairs:
                facts = self.facts(question or "", answer or "")
                sizes.append([f["words"] for f in facts])
                seqs.append([_features(f) for f in facts])
                held += len(facts)
                if held >= at_once:
                    break
            if not seqs:
                return
            yield from map(self._defect, sizes, self.field.decode_all(seqs))

    @staticmethod
    def _defect(sizes: list[int], tags: list[int]) -> str | None:
        """The defect of a pair by the words and tags of the clauses of its answer."""
        if not tags:
            return "empty"
        if not any(tags):  # all are of the answer
            return None
        share = [0] * 5
        for n, t in zip(sizes, tags):
            share[t] += n
        total = sum(share)
        if share[FOREIGN] >= 0.5 * total:
            return "other_language"
        if share[REFUSAL] >= 0.5 * (total - share[ECHO]) and share[REFUSAL]:
            return "refusal"
        if tags[-1] == UNFINISHED:
            return "truncated"
        if share[ECHO] and not share[ANSWER]:
            return "copied_question"
        return None


def defective_pairs(runs: DataFrame, run_id: str = "output_id", question: str = "question", answer: str = "answer", error: str | None = "error", sample_rows: int = 4000) -> DataFrame:
    """Columns ``run_id, defect``: each run without error whose answer is defective, with the type of its defect.

    Defects are empty, truncated, refusal, copied_question and other_language. The field is fitted on
    ``sample_rows`` distinct pairs, those of smallest hash; words are counted over all runs, every run is tagged. A null
    question counts as one without words, a null answer is empty, a null id is left out; a repeated row is one
    record. An empty table gives an empty result.
    """
    spark = runs.sparkSession
    kind = runs.schema[run_id].dataType.simpleString()
    rows = runs.filter(F.col(run_id).isNotNull())
    if error:
        rows = rows.filter(F.col(error).isNull() | (F.trim(F.col(error)) == ""))
    rows = rows.select(F.col(run_id).alias("i"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a"))
    near = F.pmod(F.xxhash64("i", F.lit(17)), F.lit(1 << 40))
    share = min(1.0, 2 * sample_rows / max(1, rows.count()))  # each task then sends a few rows, however many tasks there are
    picked = rows.select("q", "a", near.alias("h")).filter(F.col("h") < int(share * (1 << 40))).orderBy("h", "q", "a").limit(sample_rows).select("q", "a").toPandas().drop_duplicates()
    if not len(picked):
        return spark.createDataFrame([], f"`{run_id}` {kind}, defect string")
    shared = spark.sparkContext.broadcast(pickle.dumps(PairTagger(list(zip(picked.q, picked.a)), vocabulary(rows.select("q", "a")))))

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = pickle.loads(shared.value)
        for pdf in batches:
            out = pd.DataFrame({run_id: pdf.i, "defect": list(tagger.defects(zip(pdf.q, pdf.a)))})
            yield out[out.defect.notna()]

    return rows.mapInPandas(tag, f"`{run_id}` {kind}, defect string").distinct()
