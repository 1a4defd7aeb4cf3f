"""Broken prompt and response pairs (problem 1): a multi-label linear classifier over hashed n-grams and pair features.

It is trained on the corpus itself: a bounded sample of pairs gives the sound class and, truncated, copied, swapped
with an answer in another language, refused or emptied, the defective ones. Tasks make these examples and their
features, and fit the heads as logistic regressions, each on its part, whose averages make the model. Sample pairs that a fit suspects
are left out of the next one, as the sample holds real defects too. Each head's threshold is calibrated on
held-out synthetic pairs. A response gets the defect whose score exceeds its threshold by most.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from forgeline.session import materialize


DEFECTS = ("empty", "truncated", "refusal", "copied", "language")
DIM = 1 << 15
#: Weight decay of the fits, of which the first ones must not learn the defects of the sample by heart; rounds of a fit,
#: passes over the rows of a partition in a round, rows in a step, and the rate of steps.
DECAYS, ROUNDS, EPOCHS, BATCH, RATE = (1e-3, 1e-3, 3e-4), 3, 3, 128, 0.3
#: How far from the sound to the made pairs a pair of the sample is suspected.
SUSPECT = 0.33
#: The scale of n-grams where it is not 1: what an answer that breaks off is about tells little.
GRAM_SCALE = {"truncated": 0.25}
#: Where a threshold lies in the gap between the next score and the last hit.
GAP = 0.4
#: Partitions of the training sample, whose size is bounded.
SAMPLE_PARTS = 8
#: Pair features lie below this position, n-grams above; the length of the vector of a text's n-grams,
#: and the value of the flags on languages and on ends.
PAIR, GRAM_WEIGHT, FLAG = 1 << 12, 2.0, 2.0

# Frequent function words by language.
STOPWORDS = {
    "en": "the a an of to in is are was and that this it for on with by from as or if then so when what where which who why how does do can be each our its unless before because once after your you i not no there have has will without".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist sind war wird werden nicht mit auf für von zu im am aus wenn dass damit sich wo was wie warum welche wer ich sie er es noch nach bevor sobald bitte diese dieser dieses jeder unser alle kann darf dazu keine hat haben hält rufen alles".split(),
    "fr": "le la les un une des du de et est sont était que qui dans pour pas avec sur par au aux ce cette ces se ne il elle nous vous je où quels quelles quel pourquoi comment si avant afin dès sauf chaque notre tout toutes tous plus leurs sans ont être à l d qu".split(),
    "es": "el la los las un una unos unas de del y es son era que quien en para no con por al se lo su sus este esta estos cada nuestro cuando antes después donde dónde qué cómo cuál quién está como si más todas todos toda sin hay han ser a".split(),
}
STOPWORDS["ru"] = "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему когда если или ни быть был для это этот эта эти который которая которые чтобы при где почему какой через после до также их мы они можно нельзя перед каждый".split()
# Scripts by the first word of their letters' Unicode names.
SCRIPTS = {"CYRILLIC": "cyrillic", "GREEK": "greek", "CJK": "cjk", "HIRAGANA": "cjk", "KATAKANA": "cjk", "HANGUL": "hangul", "ARABIC": "arabic", "HEBREW": "hebrew", "DEVANAGARI": "devanagari", "THAI": "thai", "LATIN": "latin"}
# Sentences in other scripts, for synthetic examples of the head ``language``; the other heads do not see them.
OTHER_TEXTS = [
    "Модуль загружает индекс и проверяет каждую строку перед записью в таблицу.", "Этот класс хранит список файлов и вызывает сервис, когда ветка меняется.", "Модуль завантажує індекс і перевіряє кожен рядок перед записом.", "Η μονάδα φορτώνει το ευρετήριο και ελέγχει κάθε γραμμή πριν από την εγγραφή.",
    "该模块加载索引，并在写入表之前检查每一行。", "モジュールはインデックスを読み込み、書き込む前に各行を確認します。", "모듈은 색인을 읽고 기록하기 전에 모든 행을 확인합니다.", "تقوم الوحدة بتحميل الفهرس وتتحقق من كل سطر قبل الكتابة.", "המודול טוען את האינדקס ובודק כל שורה לפני הכתיבה.", "मॉड्यूल सूची को लोड करता है और लिखने से पहले हर पंक्ति की जाँच करता है।",
]
# Parts of which refusals are put together for synthetic examples: who declines, how, what; and lacking knowledge.
REFUSALS = {
    "en": (
        ["I", "Sorry, I", "I am sorry, but I", "I'm sorry, I", "Unfortunately I", "I'm afraid I", "I apologize, but I", "Regrettably, I", "As a language model I", "As an AI, I"],
        ["can't", "cannot", "can not", "could not", "am unable to", "am not able to", "won't", "will not", "won't be able to", "am not going to", "must decline to", "have to refuse to", "am not allowed to", "am not permitted to", "prefer not to", "may not"],
        ["answer", "help with", "assist with", "respond to", "reply to", "provide", "share", "disclose", "discuss", "comment on", "talk about", "explain", "do"],
        ["this", "that", "this question", "your question", "this request", "that request", "this information", "such details", "anything on this topic", "this one"],
        ["I do not have", "I don't have", "I have no", "I lack", "There is not", "The context does not contain", "The given sources do not contain", "I could not find", "I was not given", "Nothing I know holds"],
        ["enough information to answer", "any information about this", "access to this information", "sufficient context to respond", "the details needed for an answer", "the data required for this", "anything about that"],
    ),
    "de": (
        ["Ich", "Leider", "Tut mir leid, aber ich", "Es tut mir leid, ich", "Entschuldigung, ich", "Bedauerlicherweise", "Als Sprachmodell"],
        ["kann", "darf", "möchte", "kann leider", "darf leider", "kann ich", "darf ich"],
        ["diese Frage", "dazu", "auf diese Anfrage", "darauf", "diese Information", "hierbei", "dabei", "dazu Angaben"],
        ["nicht beantworten", "keine Auskunft geben", "nichts sagen", "nicht antworten", "nicht helfen", "nicht weitergeben", "keine Antwort geben", "nicht mitteilen", "nicht machen"],
        ["Ich habe", "Mir liegen", "Es gibt", "Der Kontext enthält", "Ich verfüge über", "Leider habe ich", "Leider liegen mir"],
        ["nicht genug Informationen für eine Antwort", "dazu keine Informationen", "keine Angaben dazu vor", "nicht genügend Kontext", "keinen Zugriff auf diese Daten", "dazu nichts", "keine Informationen vor"],
    ),
    "fr": (
        ["Je", "Désolé, je", "Je suis désolé, mais je", "Malheureusement, je", "Je regrette, mais je", "Navré, je", "En tant que modèle de langue, je"],
        ["ne peux pas", "ne suis pas en mesure de", "ne suis pas autorisé à", "refuse de", "dois refuser de", "ne souhaite pas", "ne pourrai pas", "suis incapable de"],
        ["répondre à", "vous aider avec", "fournir", "donner", "partager", "commenter", "parler de", "traiter"],
        ["cette question", "cette demande", "cela", "cette information", "ces détails", "ce sujet", "votre question"],
        ["Je n'ai pas", "Je ne dispose pas", "Le contexte ne contient pas", "Il n'y a pas", "Je manque"],
        ["assez d'informations pour répondre", "des informations nécessaires", "d'éléments à ce sujet", "accès à ces données", "de contexte pour répondre"],
    ),
    "es": (
        ["", "Lo siento, ", "Lo siento, pero ", "Lamentablemente ", "Por desgracia, ", "Disculpa, ", "Como modelo de lenguaje, "],
        ["no puedo", "no me es posible", "no estoy autorizado a", "no estoy en condiciones de", "debo negarme a", "no voy a", "no se me permite", "no podré"],
        ["responder a", "ayudar con", "contestar", "proporcionar", "compartir", "dar", "comentar", "hablar de"],
        ["esta pregunta", "esa pregunta", "esta solicitud", "eso", "esa información", "esos detalles", "este tema"],
        ["No tengo", "No dispongo de", "El contexto no contiene", "No hay", "Me falta"],
        ["información suficiente para responder", "datos suficientes", "información sobre esto", "acceso a esos datos", "el contexto necesario"],
    ),
    "ru": (
        ["Я", "К сожалению, я", "Извините, но я", "Простите, я", "Как языковая модель, я"],
        ["не могу", "не смогу", "не вправе", "отказываюсь", "не имею права", "не буду"],
        ["ответить на", "помочь с", "рассказать про", "предоставить", "обсуждать", "комментировать"],
        ["этот вопрос", "этим запросом", "это", "эту информацию", "эту тему"],
        ["У меня нет", "Мне не хватает", "В контексте нет", "Я не располагаю"],
        ["достаточной информации для ответа", "данных об этом", "доступа к этим данным", "сведений по этому вопросу"],
    ),
}
# Refusals without a person, by who or what, how and why; what may come before and after a refusal.
IMPERSONAL = {
    "en": (["This", "That", "Answering this", "This request", "Your question", "Such a request"], ["is outside of", "goes beyond", "falls outside", "is beyond", "is not within"], ["what I can do", "what I may share", "my scope", "my permissions", "the policy I follow", "what I am able to answer"]),
    "en ": (["The context", "The available context", "The material I have", "What I was given", "The search result", "The sources"], ["does not cover", "gives me nothing on", "has nothing about", "is not enough to answer", "leaves me without an answer to", "does not let me answer"], ["this", "this question", "your request", "that topic", "what you ask"]),
    "de": (["Das", "Diese Frage", "Eine Antwort darauf", "Diese Anfrage"], ["liegt außerhalb", "geht hinaus über", "steht nicht in", "übersteigt"], ["meiner Möglichkeiten", "des gegebenen Kontexts", "dessen, was ich sagen darf", "was mir vorliegt"]),
    "fr": (["Cela", "Cette question", "Une réponse à cela"], ["dépasse", "sort de", "va au-delà de"], ["mes possibilités", "ce que je peux dire", "le contexte disponible", "mes autorisations"]),
    "es": (["Eso", "Esta pregunta", "Una respuesta a eso"], ["está fuera de", "va más allá de", "excede"], ["mis posibilidades", "lo que puedo decir", "el contexto disponible", "mis permisos"]),
}
REFUSAL_STARTS = ["", "", "", "", "Hi, ", "Hello. ", "Thanks for writing. ", "Thank you for asking! ", "Guten Tag. ", "Bonjour. ", "Hola. "]
REFUSAL_ENDS = ["", ".", ".", ".", "!", " at the moment.", " with what I have.", " in this workspace.", " without more context.", " under the current rules.", ". Please ask a different question.", ". Let me know if I can do something else.", ", since the sources are silent on it.", ". Bitte frage etwas anderes.", ". N'hésitez pas à poser une autre question.", ". Puedes preguntar otra cosa.", ". Попробуйте спросить иначе."]
# Parts of sound sentences with the words of refusals: something else cannot do something, or a quoted message.
NOT_REFUSALS = {
    "en": (["The service", "A client", "It", "The worker", "This function", "The older version"], ["cannot", "is unable to", "is not allowed to", "refuses to", "will not", "does not have to"], ["open", "answer", "read", "share", "help with", "provide"], ["the request", "the file", "the lock", "this information", "the next call", "the question of a user"]),
    "de": (["Der Dienst", "Ein Client", "Die Funktion", "Der Prozess"], ["kann", "darf", "möchte"], ["die Anfrage", "diese Datei", "den Aufruf", "die Frage eines Nutzers"], ["nicht beantworten", "nicht öffnen", "nicht weitergeben", "nicht lesen"]),
    "fr": (["Le service", "Un client", "La fonction"], ["ne peut pas", "n'est pas autorisé à", "refuse de"], ["répondre à", "ouvrir", "fournir", "partager"], ["la demande", "ce fichier", "cette information"]),
    "es": (["El servicio", "Un cliente", "La función"], ["no puede", "no está autorizado a", "se niega a"], ["responder a", "abrir", "proporcionar"], ["la solicitud", "este archivo", "esa información"]),
    "ru": (["Сервис", "Клиент", "Функция"], ["не может", "не вправе", "отказывается"], ["открыть", "обработать", "прочитать"], ["запрос", "этот файл", "эту информацию"]),
}
FRAMES = ["{q}", "{q}", "You asked: {q}", "Q: {q}", "Question: {q}\nAnswer: {q}", "**{q}**", "> {q}", '"{q}"', "{q}\n{q}", "{u}", "{l}", "{t}", "{w}", "{t}.", "{t}...", "Your question: {q}", "Frage: {q}", "Pregunta: {q}"]
FRAME_WORDS = frozenset("you asked q question answer a your is was the frage antwort question réponse pregunta respuesta sie haben gefragt ihre deine vous avez demandé has preguntado su query prompt want wanted to know would like wissen wollen möchten voulez savoir quieres quiere saber here again".split())
# Parts of which answers without content are put together.
EMPTY_PARTS = ["", " ", "\n", "\t", "\u200b", "\u00a0", "\ufeff", "\u2060", "<p></p>", "<br>", "<span> </span>", "&nbsp;", "```", "**", "--", "...", '""', "()", "Answer:", "Response:", "Antwort:", "Réponse :", "Respuesta:", "- ", "# "]
LABELS = re.compile(r"\b(?:answer|response|reply|antwort|réponse|respuesta|assistant|output|result)\b\s*:?", re.I)
NUMBER_WORDS = {w: n for n, ws in {2: "two zwei deux dos", 3: "three drei trois tres", 4: "four vier quatre cuatro", 5: "five fünf cinq cinco", 6: "six sechs six seis"}.items() for w in ws.split()}
_LOCATES = re.compile(r"\.\w{1,5}[`'\"]?(?:,|:| at| in| on| an| à| en)? ?(?:(?:lines?|zeilen?|lignes?|líneas?|l\.) ?)?\d+(?: ?(?:-|–|to|bis|à|a) ?\d+)?$|^(?:lines?|zeilen?|lignes?|líneas?) \d+$", re.I)
_COUNTED = re.compile(r"\b(" + "|".join(NUMBER_WORDS) + r"|[2-9])\s+(?:steps?|parts?|places?|points?|reasons?|files?|ways?|things?|schritte?|teile|stellen|punkte|gründe|étapes?|parties|endroits|points?|raisons?|pasos|partes|lugares|puntos|razones)\b", re.I)
_LANGUAGE_NAMES = {"en": "english|englisch|anglais|inglés", "de": "german|deutsch|allemand|alemán", "fr": "french|französisch|français|francés", "es": "spanish|spanisch|espagnol|español", "ru": "russian|russisch|russe|ruso|русском|русский"}
LANGUAGE_NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "ru": "Russian"}
_OTHER_ASKED = re.compile(r"\b(?:in|auf|en|into|ins|на|to)\s+(?:russian|russisch|russe|ruso|русском|ukrainian|bulgarian|serbian|greek|griechisch|grec|griego|chinese|chinesisch|chinois|chino|japanese|japanisch|japonais|japonés|korean|koreanisch|coréen|coreano|arabic|arabisch|arabe|árabe|hebrew|hebräisch|hébreu|hebreo|hindi|thai|italian|italienisch|italien|italiano|portuguese|portugiesisch|portugais|portugués|dutch|polish|swedish|turkish|czech)\b|\btranslat|\bübersetz|\btradu", re.I)
_ASKED = {k: re.compile(r"\b(?:in|auf|en|into|ins)\s+(?:" + v + r")\b|\b(?:" + v + r")\b\W*(?:please|bitte|por favor)?\W*$", re.I) for k, v in _LANGUAGE_NAMES.items()}
_CODE = re.compile(r"```.*?(?:```|$)|`[^`]*`|\S*[/\\_]\S*|https?://\S+|\b[a-z]+[A-Z]\w*\b|\"[^\"]*\"", re.S)
_TOKEN = re.compile(r"[^\W_]+")


def _spoken(text: str) -> list[str]:
    quoted = re.sub(r"\"[^\"]*\"|“[^”]*”|«[^»]*»", " quoted ", text.replace("`", " "))
    return [w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", quoted)]


def _words(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


@functools.lru_cache(maxsize=1 << 14)
def _script_of(letter: str) -> str:
    return SCRIPTS.get(unicodedata.name(letter, "").split(" ")[0], "other")


def _scripts(text: str) -> dict[str, float]:
    """The share of each script in the letters of a text; nothing where there are hardly any."""
    letters = "".join(_LETTERS.findall(text))
    others = _NOT_ASCII.findall(letters)
    counts = Counter(map(_script_of, others))
    counts["latin"] += len(letters) - len(others)
    return {k: n / len(letters) for k, n in counts.items() if n} if len(letters) >= 4 else {}


def _language(text: str) -> tuple[str, int, int]:
    """The language with most function words, its lead over the next one, and its own count; words that no other list
    has count twice."""
    counts = dict.fromkeys(STOPWORDS, 0)
    for w in _LETTERS.findall(text.lower()):
        for k, n in _WEIGHTS.get(w, ()):
            counts[k] += n
    ranked = sorted(((n, k != "ru", k) for k, n in counts.items()), reverse=True)
    return ranked[0][2], ranked[0][0] - ranked[1][0], ranked[0][0]


_LETTERS, _NOT_ASCII = re.compile(r"[^\W\d_]+"), re.compile(r"[^\x00-\x7f]")
_WEIGHTS = {w: tuple((k, 1 + (sum(w in x for x in STOPWORDS.values()) == 1)) for k, v in STOPWORDS.items() if w in v) for v in STOPWORDS.values() for w in v}
_MARKUP, _LETTER_OR_DIGIT = re.compile(r"<[^>]*>|&\w+;"), re.compile(r"[^\W_]")


def _has_content(answer: str) -> bool:
    """Whether anything is left without invisible characters, markup, labels and marks."""
    text = LABELS.sub("", _MARKUP.sub("", answer))
    return bool(_LETTER_OR_DIGIT.search(text)) or any(unicodedata.category(c) in ("So", "Sm", "Sc") for c in text)


def _asked(query: str) -> str | None:
    """The language that a query asks for."""
    return next((k for k, r in _ASKED.items() if r.search(query.strip())), None)


def tail_flags(answer: str) -> dict[str, float]:
    """How an answer ends, as 0/1 features by name."""
    text, f = answer.rstrip(), {}
    open_fence = text.count("```") % 2
    if open_fence:
        f["open_fence"] = 1
    last = text.rsplit("\n", 1)[-1].strip()
    n_words = len(last.split())
    bullet, number = re.match(r"[-*•]\s+(.*)$", last), re.match(r"\d+[.)]\s*(.*)$", last)
    plain = re.sub(r"`[^`]*`", "x", last) if not last.startswith("```") else ""
    closed = bool(re.search(r"[.!?…。]['\")\]*_”»]*$|[^\w\s`'\"(),:;/<>{}\[\]=+*&|-]$", last)) or last.endswith("```")
    if not open_fence and plain.count("`") % 2:
        f["open_tick"] = 1
    if plain.count("(") > plain.count(")"):
        f["open_bracket"] = 1
    if last in ("-", "*", "•") or number and not number[1]:
        f["bare_item"] = 1
    elif bullet and not open_fence:
        item = bullet[1]
        whole = bool(re.search(r"\.\w{1,5}\)?$|`$|\)$", item)) or closed or not re.search(r"[/_(`]", item)
        f["item_whole" if whole else "item_cut"] = 1
    elif number and not open_fence:
        f["number_whole" if closed else "number_cut"] = 1
    elif not open_fence:
        if last.endswith(":"):
            f["announces"] = 1
        elif _LOCATES.search(last):
            f["locates"] = 1
        elif not closed:
            kind = "word" if re.search(r"[^\W\d]$", last) else "digit" if last[-1:].isdigit() else "tick" if last.endswith("`") else "paren" if last.endswith(")") else "mark"
            path = bool(re.search(r"\.\w{1,4}$", last))
            size = "short" if n_words <= 2 else "mid" if n_words <= 5 else "long"
            f[f"open_{kind}_{size}{'_path' if path else ''}{'_only' if text == last else ''}"] = 1
        else:
            f["closed"] = 1
    m = _COUNTED.search(text)
    if m and ":" in text[m.end() : m.end() + 40]:
        want = NUMBER_WORDS.get(m[1].lower()) or int(m[1])
        have = len(re.findall(r"^\s*(?:[-*•]|\d+[.)])\s+\S", text[m.end() :], re.M))
        f["count_short" if have < want else "count_met"] = 1
    return f


_CUT = {"open_fence", "open_tick", "open_bracket", "bare_item", "item_cut", "number_cut", "announces", "count_short"}


def pair_features(query: str | None, answer: str | None) -> dict[str, float]:
    return _pair(query or "", answer or "")[0]


@functools.lru_cache(maxsize=1 << 12)
def _query_facts(q: str) -> tuple[frozenset[str], str, str | None, str, int, dict[str, float], bool]:
    """Of a query: its words, itself without marks, the language it asks for, its own one and the lead of that, its
    scripts, and whether it asks for yet another language."""
    plain = _CODE.sub(" ", q)
    language, lead, _ = _language(plain)
    return frozenset(_words(q)), re.sub(r"\W+", "", q.lower()), _asked(q), language, lead, _scripts(plain), bool(_OTHER_ASKED.search(q))


def _pair(q: str, a: str) -> tuple[dict[str, float], str]:
    """The features of a pair, and the language that its answer should have."""
    if not _has_content(a):
        return {"no_content": 1.0}, "?"
    f = {k: FLAG * x for k, x in tail_flags(a).items()}
    cut = _CUT & f.keys() or any(k.startswith("open_") and ("_long" in k or "_mid" in k and "_path" not in k) for k in f)
    f["cut" if cut else "whole"] = 2 * FLAG
    qs, asked, wanted, lq, lead_q, in_query, other = _query_facts(q)
    words = _words(a)
    novel = [w for w in words if w not in qs and w not in FRAME_WORDS]
    squeezed = re.sub(r"\W+", "", a.lower())
    left = squeezed.replace(asked, "") if asked else squeezed
    f["novel_none"] = float(not novel and len(words) > 2)
    f["novel_share"] = len(novel) / max(1, len(words))
    f["copy_whole"] = float(bool(asked) and asked in squeezed and len(left) <= 24 and not novel)
    f["copy_part"] = float(len(squeezed) >= 12 and squeezed in asked)
    f["copy"] = float(bool(f["novel_none"] or f["copy_whole"] or f["copy_part"]))
    f["brief_own"] = FLAG * (len(words) <= 3 and not f["copy"])
    f["copy_then_more"] = float(bool(asked) and asked in squeezed and len(left) > 12 and bool(novel))
    plain_a = _CODE.sub(" ", a)
    la, lead_a, own = _language(plain_a)
    if lead_a > 0 and own > 1 and (wanted or lead_q > 0):
        differs = la != (wanted or lq)
        f["language_differs"] = FLAG * differs
        f["language_agrees"] = FLAG * (not differs)
    if not _LETTERS.search(plain_a):
        f["code_only"] = FLAG
    in_answer = _scripts(plain_a)
    if in_query and in_answer and not other:
        for k, n in in_answer.items():
            if k != "latin":
                f[f"script_{k}"] = max(0.0, n - in_query.get(k, 0.0))
        most = max(in_answer, key=in_answer.get)
        if in_answer[most] > 0.5 and most not in in_query and not (wanted and wanted == la):
            f["language_differs"] = FLAG
            f.pop("language_agrees", None)
    return f, wanted or (lq if lead_q > 0 else "?")


_word_id = functools.lru_cache(maxsize=1 << 17)(lambda w: zlib.crc32(w.encode("utf-8")))


def _grams(language: str, answer: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the answer's words, pairs of words, and words beside the language that is due; the
    values of each group get less with the length of the text."""
    words = _spoken(answer)
    ids = np.fromiter(map(_word_id, words), dtype=np.uint64, count=len(words))
    beside = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_word_id(language))
    keys = np.concatenate([ids * np.uint64(0xC2B2AE3D27D4EB4F), ids[:-1] * np.uint64(0x165667B19E3779F9) + ids[1:] * np.uint64(0x27D4EB2F165667C5), beside * np.uint64(0x85EBCA77C2B2AE63)])
    n = len(ids)
    values = np.full(len(keys), GRAM_WEIGHT / max(1, 2 * n - 1) ** 0.5)
    values[len(keys) - n :] = GRAM_WEIGHT / max(1, n) ** 0.5
    return ((keys >> np.uint64(20)) % np.uint64(DIM - PAIR)).astype(np.int64) + PAIR, values


def vector(query: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature positions, of which some may come again, and values; the pair features and n-grams have ranges of
    their own."""
    f, language = _pair(query or "", answer or "")
    keys, values = _grams(language, answer or "")
    own = [_word_id(k) % PAIR for k in f]
    return np.concatenate([np.array(own, dtype=np.int64), keys]), np.concatenate([np.fromiter(f.values(), dtype=np.float64, count=len(f)), values])


def _cut(rng: random.Random, answer: str) -> str | None:
    """The answer broken off inside a word, between words or inside code; None where the rest would look whole."""
    n = len(answer)
    if n < 30:
        return None
    k = rng.randrange(max(12, n // 5), n - 2)
    if rng.random() < 0.5 and " " in answer[k:]:
        k = answer.index(" ", k)
    out = answer[:k].rstrip()
    flags = tail_flags(out)
    whole = {"closed", "locates", "item_whole", "number_whole", "count_met"} & flags.keys() and not {"open_fence", "count_short"} & flags.keys()
    return None if whole or not re.search(r"\w{3}", out) or "_only" in " ".join(flags) and len(out.split()) <= 3 else out


def _refusal(rng: random.Random, language: str) -> str:
    who, how, verb, what, lack, info = REFUSALS[language]
    shape = rng.random()
    if shape < 0.25 and language in IMPERSONAL:
        parts = IMPERSONAL[rng.choice([k for k in IMPERSONAL if k.strip() == language])]
    else:
        parts = (lack, info) if shape < 0.5 else (who, how, verb, what)
    text = " ".join(rng.choice(p).strip() for p in parts).strip()
    return rng.choice(REFUSAL_STARTS) + text[:1].upper() + text[1:]


def _synthetic(rng: random.Random, sample: list[tuple[str, str]]) -> list[tuple[str, str, str | None]]:
    """Sound and defective pairs made of the sample: cut, copied, swapped, refused and emptied answers."""
    by_language: dict[str, list[str]] = {k: [] for k in STOPWORDS}
    for _, a in sample:
        k, lead, _ = _language(_CODE.sub(" ", a))
        if lead >= 3:
            by_language[k].append(a)
    out: list[tuple[str, str, str | None]] = []
    for q, a in sample:
        out.append((q, a, None))
        if (cut := _cut(rng, a)) is not None:
            out.append((q, cut, "truncated"))
        lq, lead, _ = _language(_CODE.sub(" ", q))
        if q.strip():
            t = q.strip().rstrip("?!. ").lstrip("¿¡")
            words = t.split()
            out.append((q, rng.choice(FRAMES).format(q=q.strip(), u=q.strip().upper(), l=t.lower(), t=t, w=" ".join(words[: max(2, 3 * len(words) // 4)])), "copied"))
            out.append((q, f"{q.strip()}\n\n{a}", None))
        others = [k for k in by_language if k != lq and by_language[k]]
        if others and lead > 0 and not _asked(q) and rng.random() < 0.5:
            k = rng.choice(others if rng.random() < 0.5 else [x for x in others for _ in by_language[x]])
            swapped = rng.choice(by_language[k])
            out.append((q, swapped, "language"))
            out.append((rng.choice([f"{q.strip()} Answer in {{}}.", f"{q.strip()} Please answer in {{}}", f"{q.strip()} In {{}}, please."]).format(LANGUAGE_NAMES[k]), swapped, None))
        k = rng.choice(list(REFUSALS)) if rng.random() < 0.15 or lq not in REFUSALS else lq
        out.append((q, _refusal(rng, k) + rng.choice(REFUSAL_ENDS), "refusal"))
        if lq in NOT_REFUSALS:
            decoy = " ".join(rng.choice(p) for p in NOT_REFUSALS[lq])
            decoy = rng.choice([f"{decoy}.", f"{decoy}, {a}", f"{a} {decoy}.", f'It logs "{_refusal(rng, lq)}".'])
            if _language(_CODE.sub(" ", decoy))[0] == lq:
                out.append((q, decoy, None))
        if rng.random() < 0.15:
            out.append((q, "".join(rng.choice(EMPTY_PARTS) for _ in range(rng.randrange(1, 5))), "empty"))
        if _scripts(q).get("latin", 0.0) > 0.9 and rng.random() < 0.2:
            out.append((q, rng.choice(OTHER_TEXTS), "language"))
    return out


#: Weights, thresholds, and the scores from which on a pair of the sample is suspected.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]
_EXAMPLE = "label string, held boolean, keys array<int>, values array<double>"


def _untrained() -> Model:
    """Finds nothing but answers without content."""
    w = np.zeros((len(DEFECTS), DIM + 1))
    w[0, zlib.crc32(b"no_content") % PAIR] = 1.0
    limits = np.array([0.5] + [np.inf] * (len(DEFECTS) - 1))
    return w, limits, limits


def _examples(pairs: DataFrame, model: Model | None, seed: int) -> DataFrame:
    """Features of the synthetic pairs, a fifth of them held out; pairs that ``model`` suspects are left out."""
    sent = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sample = sorted((q or "", a) for q, a in zip(batch["q"], batch["a"]))
            if sent.value is not None:
                w, _, suspect = sent.value
                sample = [p for p in sample if not (_scores(w, *vector(*p)) > suspect).any()]
            rng = random.Random(f"{seed} {len(sample)} {sample[:1]}")
            rows = [(label, rng.random() < 0.2, *vector(q, a)) for q, a, label in _synthetic(rng, sample)]
            yield pd.DataFrame(rows, columns=["label", "held", "keys", "values"])

    return materialize(pairs.mapInPandas(run, _EXAMPLE), "examples")


def _descend(w: np.ndarray, g: np.ndarray, rows: pd.DataFrame, decay: float, rng: np.random.Generator) -> None:
    """Logistic regressions, one a defect, from weights ``w`` and sums of squared steps ``g`` on, by Adagrad in place."""
    y = np.array([(rows["label"] == d).to_numpy(float) for d in DEFECTS])
    scale = np.ones((len(DEFECTS), DIM + 1))
    for d, x in GRAM_SCALE.items():
        scale[DEFECTS.index(d), PAIR:DIM] = x
    keys, values = rows["keys"].to_numpy(), rows["values"].to_numpy()
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            k = np.concatenate([np.append(keys[i], DIM) for i in some])
            x = np.concatenate([np.append(values[i], 1.0) for i in some])
            owner = np.repeat(np.arange(len(some)), [len(keys[i]) + 1 for i in some])
            for d in range(len(DEFECTS)):
                v = x * scale[d, k]
                z = np.bincount(owner, w[d, k] * v, len(some))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d, some]
                step = np.bincount(k, error[owner] * v, DIM + 1) / len(some) + decay * w[d]
                g[d] += step * step
                w[d] -= RATE * step / np.sqrt(g[d])


def _fit(examples: DataFrame, decay: float, seed: int) -> Model:
    """Weights by descent within each partition and averages of all partitions, round by round; thresholds by the
    held-out examples. What comes to the driver is bounded by partitions, defects and :data:`DIM`."""
    spark = examples.sparkSession
    known = examples.filter(~F.col("held")).repartition(SAMPLE_PARTS).persist()
    shape = (2, len(DEFECTS), DIM + 1)
    state = np.stack([np.zeros(shape[1:]), np.full(shape[1:], 1e-6)])
    try:
        for turn in range(ROUNDS):
            sent = spark.sparkContext.broadcast(state)

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                rows = [b for b in batches if len(b)]
                if rows:
                    w, g = sent.value.copy()
                    _descend(w, g, pd.concat(rows, ignore_index=True), decay, np.random.default_rng([seed, turn]))
                    yield pd.DataFrame({"state": [np.stack([w, g]).astype(np.float32).tobytes()]})

            parts = [np.frombuffer(r.state, dtype=np.float32).reshape(shape) for r in known.mapInPandas(run, "state binary").collect()]
            state = np.mean(parts, axis=0, dtype=np.float64) if parts else state
        held = examples.filter("held").select("label", "keys", "values").collect()  # a fifth of what a bounded sample gives
    finally:
        known.unpersist()
    w = state[0] * np.array([np.append(np.append(np.ones(PAIR), np.full(DIM - PAIR, GRAM_SCALE.get(d, 1.0))), 1.0) for d in DEFECTS])
    scored = np.array([_scores(w, np.array(r["keys"], dtype=np.int64), np.array(r["values"])) for r in held]).reshape(len(held), len(DEFECTS))
    truth = np.array([[r.label == name for name in DEFECTS] for r in held]).reshape(scored.shape)
    sound = ~truth.any(axis=1)
    limits = np.array([_threshold(scored[:, d], truth[:, d]) for d in range(len(DEFECTS))])
    halfway = [_between(scored[sound, d], scored[truth[:, d], d]) for d in range(len(DEFECTS))]
    return w, limits, np.minimum(limits, halfway)


def _scores(w: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    return w[:, keys] @ values + w[:, DIM]


def train(pairs: DataFrame, seed: int = 5) -> Model:
    """A model from pairs ``q, a`` of unknown soundness; an empty sample gives one that finds only empty answers. Each
    fit judges the sample, and what it suspects is left out of the next one."""
    if pairs.isEmpty():
        return _untrained()
    model = None
    for decay in DECAYS:
        model = _fit(_examples(pairs, model, seed), decay, seed)
    return model


def _between(sound: np.ndarray, made: np.ndarray) -> float:
    """The score between the middle of the sound and that of the made pairs, at ``SUSPECT`` of the way."""
    return float(np.median(sound) + SUSPECT * (np.median(made) - np.median(sound))) if len(sound) and len(made) else np.inf


def _threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """A threshold with the best F1, within the gap between the last hit and the next score."""
    if not truth.any():
        return np.inf
    order = np.argsort(-scores)
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(scores) + 1) + truth.sum())
    k = int(np.argmax(f1))
    low = scores[order[k + 1]] if k + 1 < len(scores) else scores[order[k]] - 1
    return float(low + (scores[order[k]] - low) * GAP)


def defect_of(model: Model, query: str | None, answer: str | None) -> str | None:
    w, limits, _ = model
    over = _scores(w, *vector(query, answer)) - limits
    return DEFECTS[int(np.argmax(over))] if over.max() > 0 else None


def broken_pairs(df: DataFrame, response_id: str = "response_id", query: str = "query", answer: str = "answer", sample_rows: int = 3000, seed: int = 5) -> DataFrame:
    """``response_id, defect`` of each defective response, once a response.

    The classifier is fitted on at most ``sample_rows`` pairs, those with the least hashes of their ids, a bound
    that does not grow with the table; all rows are judged, each once, and only findings are shuffled. Null and blank
    answers are ``empty`` whatever the query; a null query counts as an empty one, to which no answer is a copy or in
    the wrong language. Rows without an id give no row; of repeated rows the least defect is kept; an empty table
    gives an empty result.
    """
    rows = df.select(F.col(response_id).alias("response_id"), F.col(query).alias("q"), F.col(answer).alias("a")).filter(F.col("response_id").isNotNull())
    some = rows.filter(F.length("a") > 0).orderBy(F.xxhash64(F.lit(seed), F.col("response_id")), "response_id").limit(sample_rows).select("q", "a").distinct()
    filled = F.udf(_has_content, BooleanType())
    sample = materialize(some.filter(filled("a")).repartition(SAMPLE_PARTS, F.xxhash64("q", "a")), "sample")
    model = df.sparkSession.sparkContext.broadcast(train(sample, seed))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch[["response_id"]].assign(defect=[defect_of(model.value, q, a) for q, a in zip(batch["q"], batch["a"])])
            yield found[found["defect"].notna()]

    schema = StructType([rows.schema["response_id"], StructField("defect", StringType())])
    return rows.mapInPandas(judge, schema).groupBy("response_id").agg(F.min("defect").alias("defect"))
