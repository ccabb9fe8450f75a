"""What all text operators share: words, scripts and the common words of the eight languages."""

from __future__ import annotations

import re

#: One word: a run of anything but space, digits, ASCII signs and the punctuation and symbol blocks.
WORDS = re.compile(
    r"[^\s\d_!-/:-@\[-`{-~\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u0964\u0965"
    r"\u2000-\u2bff\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+"
)
#: Scripts written without spaces between words.
UNSPACED = re.compile(r"[\u0e00-\u0e7f\u3040-ヿ㐀-鿿豈-\ufaff]")
THAI = re.compile(r"[\u0e00-\u0e7f]")
KANA = re.compile(r"[\u3040-ヿ]")
HAN = re.compile(r"[㐀-鿿豈-\ufaff]")
DEVANAGARI = re.compile(r"[ऀ-ॿ]")
CYRILLIC = re.compile(r"[Ѐ-ԯ]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) of the
# languages that put spaces between words; no words of any subject.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they"
    " which one you were all her she there would their we him been has when who will no more if out so what up its"
    " about than into them can only other some could these two may then do did does any my over such our me most"
    " also how many before must through while where whether both each between because although under once during"
    " without within against since until though yet nor us your those every few fewer much same own very too unlike",
    "de": "der die das und in zu den von mit ist des auf für im dem nicht ein eine als auch es an werden aus er hat dass"
    " sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr"
    " durch man sein wurde wir ob ohne daher selbst unsere unser keine kein bisher warum wenn da weil obwohl"
    " außerdem ab viele später unter gegen seit während dieser diese dieses ihr ihre ihm ihn ich du uns sich was wer"
    " welche jeder jede alle können kann muss soll wieder schon sehr hier dort laut zwischen doch denn damit",
    "fr": "le la les de des du un une et à en que qui est dans pour ce il ne sur se pas plus par avec tout faire son mais"
    " on ou au aux nous vous cette sans ses leur elle été sont être comme bien selon donc ici notre ils si qu même"
    " deux aussi très peut quel quelle pourquoi enfin plusieurs après avant entre sous vers chez depuis pendant lors"
    " je tu me te lui eux ces cet sa mon ma mes ton nos vos leurs dont où quand car ni chaque"
    " quelques avons avez ont avait étaient était sera ainsi alors encore toujours jamais",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от для так же о ты все"
    " его как бы только или уже до при когда чтобы если нет этого наш об под над без где после также чем поэтому"
    " кроме того почему некоторые пока сам сами разве был была было были есть их её ей ему им них него нас вас вам"
    " нам мне меня тебя себя эти эта этой этом тот та те тем там тут здесь очень ещё ли ни же между через перед"
    " более всегда которые которая которой чтоб либо хотя потому",
    "hi": "के है का में की से को और पर यह हैं ने एक कि लिए इस जो हो गया किया भी था वह नहीं कर ही तो या जा साथ तक क्या"
    " हर होता हमने गई अधिक रही थी थे हुआ हुई हुए रहा रहे गए करना करने करते जाता जाती होती होते कोई कुछ सभी जब तब"
    " अब यदि लेकिन अपने अपनी अपना उस उन इन वे हम मैं आप उसके इसके उनके द्वारा बाद पहले बीच किसी जिस जैसे बहुत",
}
COMMON_WORDS = frozenset(word for words in COMMON.values() for word in words.split())

_OF_LANGUAGE = {language: frozenset(words.split()) for language, words in COMMON.items()}


def language(text: str, words: list[str] | None = None) -> str:
    """One of the eight languages, by script and, for Latin script, by common words; English if nothing decides."""
    if THAI.search(text) or KANA.search(text) or HAN.search(text) or DEVANAGARI.search(text) or CYRILLIC.search(text):
        n = {
            "th": len(THAI.findall(text)), "ja": len(KANA.findall(text)), "zh": len(HAN.findall(text)),
            "hi": len(DEVANAGARI.findall(text)), "ru": len(CYRILLIC.findall(text)),
        }
        if n["ja"] * 8 > n["zh"]:
            n["ja"] += n.pop("zh")
        best = max(n, key=n.__getitem__)
        if n[best] * 4 > len(LATIN.findall(text)):
            return best
    found = [w.lower() for w in (words if words is not None else WORDS.findall(text))]
    score = {x: sum(map(_OF_LANGUAGE[x].__contains__, found)) for x in ("en", "de", "fr")}
    return max(score, key=score.__getitem__)
