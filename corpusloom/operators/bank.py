"""A phrase bank for generated reasoning examples: labels, answers, names, attribute words and templates of two languages.

Names are invented by a rule and sentences are this package's own; a bank of the same form replaces it.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from .reasoning import SLOTS

#: Template slots whose wordings are divided among the splits; the others are steps, shared by all.
DIVIDED = tuple(k for k in SLOTS if not k.endswith("_step"))

_FIELDS = ("noun", "poss", "poss_obl", "whose", "howmuch", "unit", "copula", "more", "less")
_HI = """age|आयु|की|की|किसकी|कितनी|वर्ष|है|ज़्यादा|कम
height|लंबाई|की|की|किसकी|कितनी|सेंटीमीटर|है|ज़्यादा|कम
weight|वज़न|का|के|किसका|कितना|किलो|है|ज़्यादा|कम
price|दाम|का|के|किसका|कितना|रुपये|है|ज़्यादा|कम
quantity|भंडार|का|के|किसका|कितना|किलो|है|ज़्यादा|कम
distance|फ़ासला|का|के|किसका|कितना|किलोमीटर|है|ज़्यादा|कम
population|आबादी|की|की|किसकी|कितनी|लाख|है|ज़्यादा|कम
speed|रफ़्तार|की|की|किसकी|कितनी|किमी प्रति घंटा|है|ज़्यादा|कम
temperature|तापमान|का|के|किसका|कितना|डिग्री|है|ज़्यादा|कम"""
_NE = """age|उमेर|को|को|कसको|कति|वर्ष|छ|बढी|घटी
height|उचाइ|को|को|कसको|कति|सेन्टिमिटर|छ|बढी|घटी
weight|तौल|को|को|कसको|कति|किलो|छ|बढी|घटी
price|मूल्य|को|को|कसको|कति|रुपैयाँ|छ|बढी|घटी
quantity|परिमाण|को|को|कसको|कति|किलो|छ|बढी|घटी
distance|दूरी|को|को|कसको|कति|किलोमिटर|छ|बढी|घटी
population|जनसङ्ख्या|को|को|कसको|कति|लाख|छ|बढी|घटी
speed|गति|को|को|कसको|कति|किमी प्रतिघण्टा|छ|बढी|घटी
temperature|तापक्रम|को|को|कसको|कति|डिग्री|छ|बढी|घटी"""
_TEMPLATES = {
    "hi": {
        "fact": ["{E} {poss} {noun} {v} {unit} {copula}।", "मापने पर {E} {poss} {noun} {v} {unit} निकली बात {copula}।", "सूची के अनुसार {E} {poss} {noun} {v} {unit} {copula}।"],
        "rel_fact": ["{A} {poss} {noun} {B} से {cmp} {copula}।", "{B} की तुलना में {A} {poss} {noun} {cmp} {copula}।", "सूची में {A} {poss} {noun} {B} से {cmp} बताई गई बात {copula}।"],
        "q_which_of_two": ["{A} और {B} में से {whose} {noun} {cmp} {copula}?", "{noun} देखें तो {A} तथा {B} में {cmp} किधर {copula}?", "बताइए, {A} या {B}, {whose} {noun} {cmp} {copula}?"],
        "q_extreme": ["इन सबमें {whose} {noun} सबसे {cmp} {copula}?", "सबसे {cmp} {noun} {whose} {copula}?", "ऊपर के नामों में सबसे {cmp} {noun} {whose} {copula}, बताइए?"],
        "q_equality": ["क्या {A} और {B} {poss} {noun} समान {copula}?", "क्या {noun} में {A} तथा {B} बराबरी पर {copula}?", "{A} और {B} {poss} {noun} में क्या कोई अंतर नहीं {copula}?"],
        "q_difference": ["{A} {poss} {noun} {B} से {howmuch} {cmp} {copula}?", "{B} की तुलना में {A} {poss} {noun} {howmuch} {cmp} {copula}?", "{A} तथा {B} {poss_obl} {noun} में अंतर {howmuch} {copula}?"],
        "q_ordering": ["{noun} के हिसाब से नाम {cmp_from} से {cmp_to} की ओर लिखिए।", "{cmp_from} {noun} से शुरू कर {cmp_to} तक सभी नाम रखिए।", "सभी नामों को {noun} में {cmp_from} से {cmp_to} तक जमाइए।"],
        "q_middle": ["{noun} में बीच का नाम कौन सा {copula}?", "{whose} {noun} न सबसे ऊपर न सबसे नीचे {copula}?", "{noun} के क्रम में बीच में कौन {copula}?"],
        "q_verify": ["क्या यह सच {copula} कि {A} {poss} {noun} {B} से {cmp} {copula}?", "दावा: {A} {poss} {noun} {B} से {cmp} {copula}। क्या यह ठीक {copula}?", "{A} {poss} {noun} {B} से {cmp} {copula}, क्या यह सही {copula}?"],
        "fact_step": ["{E}: {noun} {v} {unit}।", "{E} {poss} {noun} = {v} {unit}।"], "rel_step": ["{A} {poss} {noun}, {B} से {cmp}।", "{B} से {cmp} {noun}: {A}।"],
        "deduce_step": ["{A} {poss} {noun} {B} से और {B} {poss} {noun} {C} से {cmp}, अतः {A} {poss} {noun} {C} से {cmp}।"],
        "flip_step": ["{A} {poss} {noun} {B} से {cmp_from}, यानी {B} {poss} {noun} {A} से {cmp_to}।"],
        "diff_step": ["{vA} - {vB} = {d} {unit}।"], "order_step": ["{noun} का क्रम: {ordered}।"], "equal_step": ["{A} और {B} {poss} {noun} एक ही, {v} {unit}।"], "conclusion_step": ["अतः उत्तर {answer}।", "इस तरह उत्तर {answer} ठहरा।"],
    },
    "ne": {
        "fact": ["{E} {poss} {noun} {v} {unit} {copula}।", "नापअनुसार {E} {poss} {noun} {v} {unit} {copula}।", "सूचीमा {E} {poss} {noun} {v} {unit} लेखिएको {copula}।"],
        "rel_fact": ["{A} {poss} {noun} {B} भन्दा {cmp} {copula}।", "{B} सँग दाँज्दा {A} {poss} {noun} {cmp} {copula}।", "सूचीमा {A} {poss} {noun} {B} भन्दा {cmp} लेखिएको {copula}।"],
        "q_which_of_two": ["{A} र {B} मध्ये {whose} {noun} {cmp} {copula}?", "{noun} हेर्दा {A} तथा {B} मा {cmp} कुन {copula}?", "भन्नुहोस्, {A} कि {B}, {whose} {noun} {cmp} {copula}?"],
        "q_extreme": ["यीमध्ये {whose} {noun} सबभन्दा {cmp} {copula}?", "सबभन्दा {cmp} {noun} {whose} {copula}?", "माथिका नाममध्ये सबभन्दा {cmp} {noun} {whose} {copula}, भन्नुहोस्?"],
        "q_equality": ["के {A} र {B} {poss} {noun} समान {copula}?", "के {noun} मा {A} तथा {B} उस्तै {copula}?", "{A} र {B} {poss} {noun} मा के कुनै फरक {copula} भन्न मिल्दैन?"],
        "q_difference": ["{A} {poss} {noun} {B} भन्दा {howmuch} {cmp} {copula}?", "{B} सँग दाँज्दा {A} {poss} {noun} {howmuch} {cmp} {copula}?", "{A} तथा {B} {poss_obl} {noun} मा फरक {howmuch} {copula}?"],
        "q_ordering": ["{noun} का आधारमा नाम {cmp_from} बाट {cmp_to} तिर लेख्नुहोस्।", "{cmp_from} {noun} बाट सुरु गरी {cmp_to} सम्म सबै नाम राख्नुहोस्।", "सबै नामलाई {noun} मा {cmp_from} देखि {cmp_to} सम्म मिलाउनुहोस्।"],
        "q_middle": ["{noun} मा बीचको नाम कुन {copula}?", "{whose} {noun} न सबभन्दा माथि न सबभन्दा तल {copula}?", "{noun} को क्रममा बीचमा को {copula}?"],
        "q_verify": ["के यो साँचो {copula} कि {A} {poss} {noun} {B} भन्दा {cmp} {copula}?", "दाबी: {A} {poss} {noun} {B} भन्दा {cmp} {copula}। के यो ठीक {copula}?", "{A} {poss} {noun} {B} भन्दा {cmp} {copula}, के यो सही {copula}?"],
        "fact_step": ["{E}: {noun} {v} {unit}।", "{E} {poss} {noun} = {v} {unit}।"], "rel_step": ["{A} {poss} {noun}, {B} भन्दा {cmp}।", "{B} भन्दा {cmp} {noun}: {A}।"],
        "deduce_step": ["{A} {poss} {noun} {B} भन्दा र {B} {poss} {noun} {C} भन्दा {cmp}, त्यसैले {A} {poss} {noun} {C} भन्दा {cmp}।"],
        "flip_step": ["{A} {poss} {noun} {B} भन्दा {cmp_from}, अर्थात् {B} {poss} {noun} {A} भन्दा {cmp_to}।"],
        "diff_step": ["{vA} - {vB} = {d} {unit}।"], "order_step": ["{noun} को क्रम: {ordered}।"], "equal_step": ["{A} र {B} {poss} {noun} उही, {v} {unit}।"], "conclusion_step": ["त्यसैले उत्तर {answer}।", "यसरी उत्तर {answer} भयो।"],
    },
}
_ENDS = {"hi": {"people": "न", "cities": "पुर", "objects": "ड़ा", "animals": "या", "fruits": "ला"}, "ne": {"people": "मान", "cities": "गढी", "objects": "को", "animals": "लो", "fruits": "ली"}}


class Bank(NamedTuple):
    """One language, or what one split may use of it."""

    lang: str
    labels: dict[str, str]
    yes: str
    no: str
    names: dict[str, list[str]]
    words: dict[str, dict[str, str]]
    templates: dict[str, list[str]]
    devanagari: bool


def _names(lang: str, n: int) -> dict[str, list[str]]:
    first, second = "कगचजटडतदनपबमरलसह", "ािीुेो"
    name = lambda i: first[i % 16] + second[i % 6] + first[(5 * i + 3) % 16] + second[(i // 6) % 6] + first[i // 96 % 16]
    return {pool: sorted({name(i) + end for i in range(n)}) for pool, end in _ENDS[lang].items()}


def default_bank(lang: str, n_names: int = 90) -> Bank:
    """The bank of ``hi`` or ``ne``."""
    rows = (line.split("|") for line in {"hi": _HI, "ne": _NE}[lang].split("\n"))
    labels = {"hi": ("सवाल", "विचार", "जवाब"), "ne": ("प्रश्न", "तर्क", "उत्तर")}[lang]
    yes, no = {"hi": ("हाँ", "नहीं"), "ne": ("हो", "होइन")}[lang]
    return Bank(lang, dict(zip(("question", "reasoning", "answer"), labels)), yes, no, _names(lang, n_names), {r[0]: dict(zip(_FIELDS, r[1:])) for r in rows}, _TEMPLATES[lang], lang == "ne")


def divided(bank: Bank, shares: dict[str, float], seed: int, least_names: int = 5) -> dict[str, Bank]:
    """What each split may use: names of each pool, and wordings of the divided slots, are each in one split.

    They are dealt in hashed order by the shares, so that each split has ``least_names`` names of a pool and one
    wording of a slot at least; a pool or slot too small for that is refused.
    """

    def deal(items: list[str], least: int) -> dict[str, list[str]]:
        order = sorted(dict.fromkeys(items), key=lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest())
        if len(order) < least * len(shares):
            raise ValueError(f"{len(order)} names or wordings are too few for {len(shares)} splits")
        spare, total, out, at = len(order) - least * len(shares), sum(shares.values()), {}, 0
        for i, (split, share) in enumerate(shares.items()):
            n = len(order) - at if i == len(shares) - 1 else least + int(spare * share / total)
            out[split], at = order[at : at + n], at + n
        return out

    names = {pool: deal(v, least_names) for pool, v in bank.names.items()}
    templates = {slot: deal(v, 1) if slot in DIVIDED else dict.fromkeys(shares, v) for slot, v in bank.templates.items()}
    return {s: bank._replace(names={p: v[s] for p, v in names.items()}, templates={k: v[s] for k, v in templates.items()}) for s in shares}
