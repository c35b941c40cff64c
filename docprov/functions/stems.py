"""Stems of German, French and Spanish words by the published suffix algorithms, and stop words.

Each takes a lower-case word. R1 is what follows the first consonant behind a vowel, R2 the
same again within R1, RV as each language defines it; endings go only if they lie there.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Vowels, endings and stop words of the three algorithms.
GERMAN_VOWELS, FRENCH_VOWELS, SPANISH_VOWELS = "aeiouyäöü", "aeiouyâàëéêèïîôûù", "aeiouáéíóúü"
SPANISH_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
SPANISH_GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir", "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir"}
SPANISH_VERBS = (
    "aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos ásemos arían arías aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis íamos "
    "arán arás aría erán erás ería irán irás iría iera iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos amos imos ará aré erá eré irá iré aba ada ida ara ase ían ado ido ías áis ía ad ed id an ió ar er ir as ís"
).split()
FRENCH_I_VERBS = "issaIent issantes iraIent issante issants issions irions issais issait issant issent issiez issons irais irait irent iriez irons iront isses issez îmes îtes irai iras irez isse ies ira ît ie ir is it i".split()
FRENCH_VERBS_KEPT, FRENCH_VERBS = "eraIent erions èrent erais erait eriez erons eront erai eras erez ées era iez ée és er ez é".split(), "assions assent assiez aIent antes asses âmes âtes ante ants asse ais ait ant ât ai as a".split()
STOP = {
    "german": frozenset("aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes auch auf aus bei bin bis bist da damit dann der den des dem die das dass daß derselbe dein deine deinem deinen deiner deines denn dich dir du dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines einig einige einigem einigen einiger einiges einmal er ihn ihm es etwas euer eure eurem euren eurer eures für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihre ihrem ihren ihrer ihres euch im in indem ins ist jede jedem jeden jeder jedes jene jenem jenen jener jenes jetzt kann kein keine keinem keinen keiner keines können könnte machen man manche manchem manchen mancher manches mein meine meinem meinen meiner meines mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine seinem seinen seiner seines selbst sich sie ihnen sind so solche solchem solchen solcher solches soll sollte sondern sonst über um und uns unsere unserem unseren unser unseres unter viel vom von vor während war waren warst was weg weil weiter welche welchem welchen welcher welches wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen".split()),
    "french": frozenset("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient".split()),
    "spanish": frozenset("de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy estás está estamos estáis están es somos sois son he has ha hemos habéis han fue fueron era eran tiene tienen".split()),
}
# End of the fixed values.


def _regions(word: str, vowels: str) -> tuple[int, int]:
    after = re.compile(f"[{vowels}][^{vowels}]")
    m = after.search(word)
    first = m.end() if m else len(word)
    m = after.search(word, first)
    return first, m.end() if m else len(word)


def _ending(word: str, endings: object) -> str:
    """The longest ending of a word."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def german(word: str) -> str:
    v = GERMAN_VOWELS
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    first, second = _regions(w, v)
    first = max(first, 3)
    e = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    at = len(w) - len(e)
    if e and at >= first and (e != "s" or w[at - 1 : at] in tuple("bdfghklmnrt")):
        w = w[:at]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _ending(w, ("en", "er", "est", "st"))
    at = len(w) - len(e)
    if e and at >= first and (e != "st" or (at >= 4 and w[at - 1] in "bdfghklmnt")):
        w = w[:at]
    e = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    at = len(w) - len(e)
    if e and at >= second:
        if e in ("end", "ung"):
            w = w[:at]
            if w.endswith("ig") and at - 2 >= second and w[at - 3 : at - 2] != "e":
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w[:at] if w[at - 1] != "e" else w
        elif e in ("lich", "heit"):
            w = w[:at]
            if w.endswith(("er", "en")) and at - 2 >= first:
                w = w[:-2]
        else:
            w = w[:at]
            own = _ending(w, ("lich", "ig"))
            if own and at - len(own) >= second:
                w = w[: -len(own)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _spanish_rv(w: str) -> int:
    v = SPANISH_VOWELS
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
    elif w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
    else:
        return 3
    return m.end() if m else len(w)


@lru_cache(maxsize=200_000)
def spanish(word: str) -> str:
    w = word
    rv, (first, second) = _spanish_rv(w), _regions(w, SPANISH_VOWELS)
    # Pronouns behind a gerund or an infinitive.
    e = _ending(w, SPANISH_PRONOUNS)
    if e and len(w) - len(e) >= rv:
        base = w[: -len(e)]
        verb = _ending(base[rv:], SPANISH_GERUNDS)
        if verb:
            w = base[: -len(verb)] + SPANISH_GERUNDS[verb]
        elif base.endswith("yendo") and len(base) - 5 >= rv and base[-6:-5] == "u":
            w = base
    before = w
    e = _ending(w, ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos adora ador ación adoras adores aciones ante antes ancia ancias acion logía logías ución uciones ucion encia encias amente mente idad idades iva ivo ivas ivos").split())
    at = len(w) - len(e)

    def less(w: str, *endings: str) -> str:
        own = _ending(w, endings)
        return w[: -len(own)] if own and len(w) - len(own) >= second else w

    if e:
        if e == "amente":
            if at >= first:
                w = w[:at]
                w = less(less(w, "iv"), "at") if w.endswith("iv") and at - 2 >= second else less(w, "os", "ic", "ad")
        elif at >= second:
            w = w[:at]
            if e in ("adora", "ador", "ación", "acion", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
                w = less(w, "ic")
            elif e in ("logía", "logías"):
                w += "log"
            elif e in ("ución", "ucion", "uciones"):
                w += "u"
            elif e in ("encia", "encias"):
                w += "ente"
            elif e == "mente":
                w = less(w, "ante", "able", "ible")
            elif e in ("idad", "idades"):
                w = less(w, "abil", "ic", "iv")
            elif e in ("iva", "ivo", "ivas", "ivos"):
                w = less(w, "at")
    if w == before:
        e = _ending(w[rv:], ("ya ye yan yen yeron yendo yo yó yas yes yais yamos").split())
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = _ending(w[rv:], [*SPANISH_VERBS, "en", "es", "éis", "emos"])
            if e in ("en", "es", "éis", "emos"):
                w = w[: -len(e)]
                w = w[:-1] if w.endswith("gu") else w
            elif e:
                w = w[: -len(e)]
    e = _ending(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def _french_rv(w: str) -> int:
    v = FRENCH_VOWELS
    if w[:3] in ("par", "col", "tap") or (len(w) > 1 and w[0] in v and w[1] in v):
        return min(3, len(w))
    m = re.compile(f"[{v}]").search(w, 1)
    return m.end() if m else len(w)


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    v = FRENCH_VOWELS
    w = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    w = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", w)
    w = re.sub("qu", "qU", w)
    rv, (first, second) = _french_rv(w), _regions(w, v)
    before, verbs = w, False

    def at(e: str) -> int:
        return len(w) - len(e)

    e = _ending(w, "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split())
    if e in "ance iqUe isme able iste eux ances iqUes ismes ables istes".split() and at(e) >= second:
        w = w[: at(e)]
    elif e in "atrice ateur ation atrices ateurs ations".split() and at(e) >= second:
        w = w[: at(e)]
        if w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= second else w[:-2] + "iqU"
    elif e in ("logie", "logies") and at(e) >= second:
        w = w[: at(e)] + "log"
    elif e in ("usion", "ution", "usions", "utions") and at(e) >= second:
        w = w[: at(e)] + "u"
    elif e in ("ence", "ences") and at(e) >= second:
        w = w[: at(e)] + "ent"
    elif e in ("ement", "ements") and at(e) >= rv:
        w = w[: at(e)]
        if w.endswith("iv") and len(w) - 2 >= second:
            w = w[:-2]
            if w.endswith("at") and len(w) - 2 >= second:
                w = w[:-2]
        elif w.endswith("eus"):
            w = w[:-3] if len(w) - 3 >= second else w[:-1] + "x" if len(w) - 3 >= first else w
        elif w.endswith(("abl", "iqU")) and len(w) - 3 >= second:
            w = w[:-3]
        elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif e in ("ité", "ités") and at(e) >= second:
        w = w[: at(e)]
        if w.endswith("abil"):
            w = w[:-4] if len(w) - 4 >= second else w[:-4] + "abl"
        elif w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= second else w[:-2] + "iqU"
        elif w.endswith("iv") and len(w) - 2 >= second:
            w = w[:-2]
    elif e in ("if", "ive", "ifs", "ives") and at(e) >= second:
        w = w[: at(e)]
        if w.endswith("at") and len(w) - 2 >= second:
            w = w[:-2]
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= second else w[:-2] + "iqU"
    elif e == "eaux":
        w = w[:-1]
    elif e == "aux" and at(e) >= first:
        w = w[: at(e)] + "al"
    elif e in ("euse", "euses"):
        w = w[: at(e)] if at(e) >= second else w[: at(e)] + "eux" if at(e) >= first else w
    elif e in ("issement", "issements") and at(e) >= first and w[at(e) - 1] not in v:
        w = w[: at(e)]
    elif e == "amment" and at(e) >= rv:
        w, verbs = w[: at(e)] + "ant", True
    elif e == "emment" and at(e) >= rv:
        w, verbs = w[: at(e)] + "ent", True
    elif e in ("ment", "ments") and at(e) - 1 >= rv and w[at(e) - 1] in v:
        w, verbs = w[: at(e)], True
    if w == before or verbs:
        start = w
        own = _ending(w[rv:], FRENCH_I_VERBS)
        if own and len(w) - len(own) - 1 >= rv and w[-len(own) - 1] not in v:
            w = w[: -len(own)]
        if w == start:
            own = _ending(w[rv:], [*FRENCH_VERBS_KEPT, *FRENCH_VERBS, "ions"])
            if own == "ions":
                w = w[:-4] if len(w) - 4 >= second else w
            elif own in FRENCH_VERBS_KEPT:
                w = w[: -len(own)]
            elif own:
                w = w[: -len(own)]
                w = w[:-1] if w.endswith("e") and len(w) - 1 >= rv else w
        changed = w != before
    else:
        changed = True
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        own = _ending(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if own == "ion":
            w = w[:-3] if len(w) - 3 >= second and len(w) - 4 >= rv and w[-4] in "st" else w
        elif own in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(own)] + "i"
        elif own == "e":
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{v}]+)\Z", r"e\1", w)
    return w.lower()


STEMMERS = {"german": german, "french": french, "spanish": spanish}
