"""Abusive, hateful or sexual content by weak supervision.

Many voters, each a lexicon or a pattern, vote on passages (sentences). Words belong to classes that several
languages share (who is spoken to, who is spoken of, insults, violence, exclusion ...), and the patterns are grammar
over these classes, not phrases. A generative label model estimates from the counts of all vote combinations how
accurate each voter is and how correlated voters are, and gives each passage a posterior. A linear classifier over
words, word pairs and class pairs is trained on the posteriors of a bounded sample and scores every passage of
every document; a document's score is that of its worst passage.

Where some documents were judged by reviewers, their judgements vote too: passages of documents that they found
harmless train the classifier as such, those of documents that they found abusive if they are voted abusive or have a
clue (a word or word pair that occurs nearly only in such documents), and a judgement moves its document's score by
how often reviewers agree.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from docflow.llm.lookalikes import Canon
from docflow.llm.mixing import source_key
from docflow.session import Stage, broadcast_if_small

#: Passages of each kind (voted abusive, voted harmless, without votes) that the classifier is trained on, at most.
MAX_TRAIN = 20_000
#: One of so many passages without votes is offered for training.
UNVOTED_PART = 8
#: Weight of a passage without votes in training; that of one with votes goes from 0.3 to 1.
UNVOTED_WEIGHT = 0.4
#: Weights below this are dropped: most are, and a small table is looked up faster.
LEAST_WEIGHT = 0.001
#: Rows of a training step.
BATCH = 64
#: Words that a task remembers, at most.
PLAIN_WORDS = 300_000
#: Words of a passage; a longer sentence is read in windows of so many, each beginning in the middle of the last.
WINDOW = 80
#: Words and word pairs that tell reviewed abusive documents from others, at most; documents that have one at least and
#: their least part of all that do.
MAX_CLUES, CLUE_DOCUMENTS, CLUE_PART = 200_000, 4, 0.8
#: A judgement's weight in the score, at most.
MOST_EVIDENCE = 3.4
#: A document is reported from this score on.
THRESHOLD = 0.5

# Words by class, in lower case, several languages together. Endings are taken off by rule.
CLASSES = {
    # Who is spoken to.
    "you": """you your yours yourself yourselves ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinem deinen
        euch euer eure ihr tú ti tus usted ustedes vosotros vuestro contigo ты тебя тебе тобой твой твоя вы вас вам""",
    # Who is spoken of.
    "they": """he him his she her hers they them their theirs someone somebody anyone anybody everyone everybody nobody people person man men
        woman guy guys folks boy girl kid boss colleague neighbour neighbor brother sister mother mom mum mama father daughter son wife husband family il elle ils
        elles eux leur leurs lui gens personne homme mère père fille fils soeur frère er sie ihn ihm ihnen leute jemand niemand mann
        mutter vater tochter sohn schwester bruder él ella ellos ellas gente alguien nadie hombre mujer madre padre hija hijo он она они их его её люди""",
    "speaker": "i me my myself we us our je moi mon ma mes nous notre ich mich mir mein meine wir uns unser yo mi mis nosotros nuestro я мы нас",
    "be": """am are is was were be been being become remain look sound smell seem act behave es est sont êtes sommes était étaient bist ist sind
        seid war waren bleibst son eres soy somos era eran parece pareces""",
    "modal": """will shall would should must ought need gonna wanna let can could might may going vais vas va allons vont veux devrais devrait devraient faut peux
        werde wirst wird werden will soll sollte sollten sollst muss müssen müsste kann könnte voy vas vamos van debe deben debería deberían hay quiero puedo""",
    "violence": """kill shoot stab strangle choke beat punch smash hang drown murder slaughter butcher lynch hurt crush bury burn slit whip cripple maim torture behead
        execute massacre break bash batter gut skin slap kick tuer tue buter crever étrangler égorger frapper cogner pendre noyer brûler fracasser péter casser massacrer
        töten töte umbringen umlegen erschießen erschlagen erwürgen abstechen aufhängen ertränken verprügeln verbrennen schlagen schlage prügeln
        matar mato mate mataré golpear apuñalar ahorcar ahogar quemar degollar reventar romper partir pegar убью убить зарежу""",
    "harm": """die rot suffer bleed choke perish drown burn hang crash mourir meurs crève crèves crevez pourrir sterben stirb verrecken verreck verrecke krepieren
        krepier ersticken morir muere mueras mueran muérete pudrirte pudras pudran revienta revientes сдохни умри""",
    "wish": "hope wish pray deserve deserves hopefully espère souhaite mérite mérites hoffe hoffentlich wünsche verdienst verdient verdienen ojalá espero deseo merece mereces merecen надеюсь",
    "insult": """idiot moron imbecile cretin halfwit dimwit nitwit dunce dumbass dumbo retard loser scumbag dirtbag lowlife creep freak pervert degenerate fool clown jerk
        coward liar thief bastard bitch hag slob dork prat git muppet numpty pillock plonker tosspot bellend wanker twat bozo buffoon simpleton crybaby traitor
        crétin abruti débile taré imbécile raclure ordure minable bouffon connard connasse salaud salope bâtard pouffiasse idiote nul tocard clochard lâche menteur crevure
        idiot idiotin trottel versager penner dummkopf depp vollpfosten missgeburt dreckschwein drecksau arschloch schlampe hurensohn wichser mistkerl schwachkopf
        blödmann miststück feigling lügner bastard spast vollidiot imbécil idiota inútil estúpido tonto payaso zorra cabrón gilipollas pendejo mamón bastardo cobarde
        mentiroso desgraciado malnacido subnormal retrasado canalla sinvergüenza идиот дурак дебил урод тварь сволочь придурок кретин cretino stronzo""",
    "degrading": """stupid dumb ugly fat lazy filthy dirty smelly stinking disgusting repulsive pathetic worthless useless brainless spineless gutless clueless braindead
        greasy inbred retarded vile miserable incompetent inferior subhuman primitive savage revolting hideous moronic idiotic imbecilic bête moche gros grosse sale dégoûtant
        puant laid inutile stupide pathétique minable dumm doof hässlich fett faul dreckig widerlich ekelhaft eklig wertlos nutzlos blöd stinkend erbärmlich
        minderwertig feo fea gordo vago sucio asqueroso repugnante patético apestoso estúpida inútiles тупой тупая жирный""",
    "vermin": """vermin pig swine cow schwein cerdo cochon porc rat cockroach roach lice maggot parasite leech scum filth trash garbage rubbish waste plague disease cancer ape monkey animal dog beast insect worm
        savages subhumans vermine rat cafard parasite racaille déchet poubelle chien singe animal ungeziefer ratte kakerlake parasit abschaum dreck müll
        abfall affe tier untermensch hund rata cucaracha parásito escoria basura gusano plaga alimaña mono animal perro отбросы мусор""",
    "group": """immigrant migrant foreigner refugee jew muslim christian catholic hindu black white asian arab mexican african gypsy roma gay lesbian trans transgender
        homosexual queer disabled cripple women woman females blacks whites arabs jews muslims gays lesbians islam poor homeless peasants natives indians
        chinese turks pakistanis poles americans russians étranger immigré migrant réfugié arabe juif musulman noir homo pédé gitan femmes handicapé ausländer
        flüchtling jude juden muslim moslem türke türken schwule schwul lesbe behinderte frauen asylant zigeuner neger schwarze inmigrante extranjero negro judío
        musulmán moro gitano maricón mujeres refugiado mexicano discapacitado евреи мусульмане мигранты чурки""",
    "slur": """nigger nigga faggot fag dyke tranny spic chink gook kike wetback raghead paki towelhead coon wop darkie redskin negro bougnoule youpin tarlouze tapette pédale
        kanake kanacke kümmeltürke schwuchtel tunte sudaca maricón bollera moro panchito хач жид пидор""",
    "expel": """deport expel ban lock jail cage ship throw kick gas remove exterminate eradicate eliminate wipe purge sterilise sterilize castrate banish evict exclude cleanse
        expulser jeter virer renvoyer chasser enfermer exterminer éliminer abschieben rauswerfen rausgeworfen vergasen einsperren ausrotten vernichten entsorgen rausschmeißen
        expulsar echar deportar encerrar eliminar exterminar fusilar tirar""",
    "profane": """fuck fucking fucked fucker motherfucker shit shitty shithead bullshit dipshit dickhead asshole arsehole arse ass cunt twat prick wanker bitch slut whore
        bollocks bugger goddamn damn douchebag douche jackass crap merde foutre enculé connard connasse con conne salope pute putain bordel chier cul couilles
        scheiße scheisse scheiß arsch arschloch fotze fresse hure wichser verpiss verpisst kacke fick ficken gefickt mierda puta puto joder coño hostia cojones carajo chingar chinga verga
        pinche culo cazzo merda stronzo vaffanculo puttana porra caralho foda блять сука хуй пизда ебать ебаный kurwa""",
    "sexual": """tits boobs pussy cock dick penis vagina clit cum horny naked nude nudes topless panties nipple crotch butt blowjob handjob orgasm porn porno sexy spank
        erection masturbate masturbating sex lick suck hump thighs cleavage boner dildo threesome anal fuck screw bang seins nichons bite chatte queue poil nue sexe sucer lécher
        baiser bander jouir culotte titten schwanz muschi nackt nackte nackten nacktbilder geil blasen lecken bumsen vögeln ficken wichsen follar follarte tetas polla desnuda desnudo
        desnudas desnudos chupar lamer coger cachondo cachonda bragas trasero порно секс голая сиськи""",
    "body": "face head skull teeth neck throat legs bones knees ribs nose jaw brains gueule tête visage dents jambes gorge figure fresse gesicht schädel zähne kopf hals cara cabeza boca dientes cuello piernas",
    "go": "go get piss shut crawl drop back off away va dégage casse ferme tire geh hau halt verpiss raus vete lárgate cállate cierra иди пошёл заткнись",
    "never": "never nobody none nothing not no only jamais personne rien nie niemand nichts nur kein nunca nadie nada solo sólo",
    "hate": "hate despise loathe detest déteste hais hasse verachte odio detesto desprecio ненавижу",
}
#: Insults and obscenities of languages whose words aren't set apart.
UNSPACED = "傻逼 傻子 白痴 蠢货 蠢猪 混蛋 王八蛋 操你 他妈 妈的 去死 滚蛋 垃圾人 贱人 婊子 杀了你 弄死你 死ね 馬鹿 くたばれ 殺す 개새끼 씨발 병신"
# Words of trades, of care and of reports, by which a passage is likely about something else.
TECHNICAL = """algorithm server database network node process thread memory disk cache queue cluster scheduler kernel driver module function variable pointer compiler
    benchmark pipeline script parser index record header file folder backup log port cable hardware software firmware router bug patch release version deployment test testing
    machine engine pump valve pressure steel concrete drill bolt welding invoice payment budget asset shares portfolio fund balance audit tax insurance premium capital
    serveur base données réseau fichier rapport facture datei netzwerk speicher rechnung bericht prozess servidor datos archivo factura informe proceso"""
CARE = """patient patients doctor nurse clinic hospital medical surgery surgeon diagnosis treatment therapy symptom symptoms screening vaccine infection tissue tumour tumor
    pregnancy fertility reproductive contraception anatomy biology species farm farmer veterinary vet breed breeding livestock cattle zoo wildlife harvest crop pest pests
    control museum painting sculpture exhibition patiente médecin hôpital santé traitement vétérinaire arzt klinik krankenhaus behandlung gesundheit tierarzt médico hospital
    salud tratamiento veterinario"""
REPORTING = """report reports reported policy policies training handbook harassment complaint complaints investigation tribunal court law article chapter study survey research
    statistics awareness campaign forbids prohibits prohibited guideline guidelines moderation moderator filter definition example quote victim victims support charity
    discrimination prevention règlement politique harcèlement plainte formation étude loi richtlinie belästigung beschwerde schulung studie gesetz verbot política acoso queja
    formación estudio ley prevención"""
SORRY = "sorry apologise apologize apologies apology thanks thank grateful please kindly désolé merci pardon entschuldigung danke bitte verzeihung perdón gracias disculpa"

#: Idioms of insult, threat and exclusion, by language.
IDIOMS = """waste of space|waste of air|waste of oxygen|good for nothing|go to hell|rot in hell|burn in hell|drop dead|shut up|shut your mouth|get lost|piss off|fuck off
    |screw you|piece of shit|piece of crap|son of a bitch|your kind|go back to your|back where you came|know where you live|watch your back|you will regret|you'll regret
    |you will pay for|make you pay|never been born|better off dead|better off without you|better place without|nobody likes you|nobody wants you|nobody needs you|nobody would miss
    |no one would miss|make me sick|too stupid|too dumb|dumb as|half a brain|no brain|less than human|not even human|breed like|take our jobs|steal our jobs|taking over our
    |out of our country|kill yourself|hang yourself|i will find you|i'll find you|get what you deserve|got what you deserve|disgrace to|shame on you|who do you think you are|up your ass|up your arse
    |ta gueule|va te faire|nique ta|fils de pute|bande de|espèce de|casse-toi|dégage|va crever|dans ton pays|rentre chez toi|sale race|tu vas voir|me dégoûte|bon à rien|bonne à rien|ne vaux rien
    |personne ne t'aime|tu ne sers à rien|honte à toi|va mourir|on va te trouver
    |halt die fresse|halt die klappe|halt's maul|halt dein maul|fick dich|verpiss dich|leck mich|geh sterben|mach dich fertig|bring dich um|bringe dich um|finde dich|zu blöd|zu dumm|geh zurück
    |ausländer raus|raus aus unserem|nichts wert|keiner mag dich|niemand vermisst|niemand braucht dich|hau ab|schäm dich|wirst du bereuen|du gehörst|gehören eingesperrt
    |hijo de puta|vete a la mierda|que te jodan|que te den|cállate|cierra la boca|das asco|no vales nada|no sirves para nada|pedazo de|vuelve a tu país|fuera de nuestro|te vas a enterar
    |ojalá te|muérete|nadie te quiere|nadie te echa|vergüenza me darías|te voy a encontrar|te arrepentirás|no vale nada"""
#: Words that make someone one of a kind, before who is spoken to.
ALIKE = "like comme como wie"
#: Forms that are everyday words of another language than that of the class's word.
EVERYDAY = "con gross queue retarde retarder bitte gut gute guten sale sales bite bites locks lock casse cage renvoyer partir retire nul nulle skin base back drop off tire mate animal test fall"
#: German words by which "die" is the article.
GERMAN = "der das und ist nicht ein eine einen mit für den dem zu von auf im wir ich es sind wird werden nach bei aus wie als auch sie"

#: Letters for classes in a passage's class string.
LETTERS = {
    "you": "Y", "they": "T", "speaker": "I", "be": "B", "modal": "M", "violence": "V", "harm": "D", "wish": "H", "insult": "N", "degrading": "A", "vermin": "R", "group": "G",
    "slur": "L", "expel": "E", "profane": "P", "sexual": "S", "body": "O", "go": "C", "never": "Z", "hate": "J",
}
#: Grammar over class strings, in which any other word is a dot.
PATTERNS = {
    "threat": r"I[^IYTG]{0,5}V[^I]{0,5}?[YTGOL]|IM?.?V[YTO]|IM.{0,2}[YT].{0,2}V|V.{0,2}Y.{0,3}O|Y.{0,3}M.{0,3}(?:D|V)",
    "curse": r"H.{0,4}[YTGL].{0,4}[DV]|[DVC]Y(?!.{0,6}I)|(?:^|[.])D$|H.{0,2}DY?",
    "directed": r"[PC]{1,2}.?Y|[PC].?[TG]|C.{0,3}P|P.{0,1}C|Y.{0,3}P.{0,2}[NRP]|P.{0,2}V?Y",
    "you_are": r"YB.{0,4}[NARLP]|Y.?.?[NRL]|[NAL]{1,2}.{0,3}[YN]|BY.{0,3}[NARLP]|[NR].{0,2}Y|YM.{0,3}[NA]",
    "they_are": r"[TGL]B.{0,4}[NARL]|[TG].{0,2}[NR](?!.{0,3}I)|[NAR].{0,3}[TG]B|[AP].{0,1}[GLT]",
    "group_is": r"[GL].{0,3}B.{0,5}[NARPDV]|[GL].{0,6}[RL]|A.{0,2}[GL]|R.{0,4}[GL]|[GL]{1,2}.{0,4}Z.{0,4}[NARSV]|J.{0,4}[GL]",
    "exclusion": r"[GLTR].{0,5}M.{0,4}[EVD]|[GLR].{0,4}B?.{0,3}E|E.{0,5}[GLR]|M.{0,3}[EV].{0,4}[GLR]|C.{0,4}[GL]|Z.{0,3}M.{0,4}[GL]|[GLT].{0,4}H.{0,4}[DVEZ]",
    "explicit": r"[IY].{0,6}S.{0,4}[YITS]|S.{0,3}[YIT].{0,6}S|[YIT].{0,3}S.{0,5}S|V.{0,3}Y.{0,4}S|S.{0,6}Y|I.{0,3}M.{0,3}S|PS|SP|S.{0,2}S.{0,2}S|I.{0,3}M.{0,2}PY",
    "scorn": r"Y.{0,8}Z.{0,6}[NADR]|Z.{0,8}Y.{0,5}[DNA]|[NA].{0,3}[NA].{0,6}[YTGI]|J.{0,3}[YT]|Y.{0,10}[AN].{0,3}[AN]",
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}

#: The voters, for abuse and against it, in the order of their bits.
FOR = ("insult", "profane", "sexual", "slur", "hidden", "idiom", "alike", *PATTERNS)
AGAINST = ("technical", "care", "reporting", "sorry", "impersonal", "self")
VOTERS = FOR + AGAINST
_FOR_MASK = (1 << len(FOR)) - 1

# Endings by which a word's form differs from the one in the lists.
_ENDINGS = "s es n en er ern em e d ed ing in innen ly est x a as o os ne nes t te me se le los las r ent é ée és ées ant ando iendo".split()
_HANGING = frozenset("te me se le los las".split())
_ALL_CLASSES: dict[str, set[str]] = {}
for _name, _text in CLASSES.items():
    for _word in _text.split():
        _ALL_CLASSES.setdefault(_word, set()).add(_name)
#: Of several classes of a word the first of these gives its letter.
_ORDER = ("slur", "insult", "profane", "sexual", "vermin", "degrading", "violence", "expel", "harm", "group", "hate", "wish", "you", "speaker", "they", "modal", "body", "go", "never", "be")
_GRAMMAR = frozenset(("you", "they", "speaker", "be", "modal", "go", "never", "body"))
_LEXICON = frozenset(w for name in ("insult", "degrading", "profane", "sexual", "slur", "vermin") for w in CLASSES[name].split() if len(w) > 2)
_SIGNAL = frozenset("NAPSLRVEDJ")
_EVERYDAY, _GERMAN = frozenset(EVERYDAY.split()), frozenset(GERMAN.split())
_ABOUT = {name: frozenset(text.split()) for name, text in (("technical", TECHNICAL), ("care", CARE), ("reporting", REPORTING), ("sorry", SORRY))}
_ALIKE = re.compile(rf"(?<!\w)(?:{'|'.join(ALIKE.split())}) (?:you|him|her|them|that lot|toi|vous|lui|eux|dich|dir|du|ihn|ihr|tú|vosotros|él|ellos)(?!\w)")
# Of each idiom and likeness a word, so that most passages need no search.
_RAREST = frozenset(max(re.findall(r"[^\W\d_]+", x), key=len) for x in IDIOMS.split("|")) | frozenset(ALIKE.split())
_UNSPACED = regex.compile("|".join(UNSPACED.split()))
_ZEROS = repeat(0.0)
_ASCII_DIGITS = frozenset("0123456789")


def classes_of(word: str) -> frozenset[str]:
    """Classes of a word as it is, else without its ending; grammatical words only as they are."""
    if word in _EVERYDAY:
        return frozenset()
    own = _ALL_CLASSES.get(word)
    if own:
        return frozenset(own)
    if "'" in word or "’" in word:  # an elided article or pronoun before a word
        return classes_of(re.split("['’]", word)[-1])
    if len(word) > 3:
        for ending in _ENDINGS:
            if word.endswith(ending):
                bare = word[: -len(ending)]
                # A participle's verb, a verb that a pronoun hangs on, else what an ending with or without e leaves.
                forms = (bare + "er",) if ending[0] == "é" else (bare,) if ending in _HANGING else (bare, bare + "e", bare[:-1] if bare[-1:] == bare[-2:-1] else bare)
                for form in forms:
                    if len(form) > 2 and len(form) + len(ending) > 3 + (len(form) < 4 and len(ending) < 2 and ending != "s") and (found := _ALL_CLASSES.get(form, set()) - _GRAMMAR):
                        return frozenset(found)
    if not word.isascii() and _UNSPACED.search(word):
        return frozenset(("insult", "you"))
    return frozenset()


class _Letters(dict):
    """The letter of a word's first class; a dot for words of none. What was seen is remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) >= PLAIN_WORDS:
            self.clear()
        found = classes_of(word)
        self[word] = letter = next((LETTERS[c] for c in _ORDER if c in found), ".")
        return letter


_LETTER = _Letters()


def class_string(words: list[str]) -> str:
    """The letters of a passage's words."""
    letters = "".join(map(_LETTER.__getitem__, words))
    if "J" in letters:  # who hates to do something hates nobody
        letters = "".join("." if c == "J" and after == "to" else c for c, after in zip(letters, [*words[1:], ""]))
    if "D" in letters and "die" in words and not _GERMAN.isdisjoint(words):
        letters = "".join("." if w == "die" else c for w, c in zip(words, letters))
    return letters


# Ends of passages, and what takes their place.
_ENDS, _WIDE_ENDS, _CUT = (". ", "\n", "! ", "? "), ("。", "！", "？"), "\0"
# Bytes of Latin-1 that aren't in words become blanks.
_FLAT = bytes(c if chr(c).isalnum() or chr(c) in "'-\0" else 32 for c in range(256))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
# What a hidden word has: marks or digits between letters, single letters set apart, stretched letters.
_HINT = re.compile(r"[a-zà-ÿ][@$*+!|€0-9][a-zà-ÿ@$*+!|€0-9]|[a-zà-ÿ][._][a-zà-ÿ]|\b[a-zà-ÿ]-[a-zà-ÿ]-[a-zà-ÿ]\b|([a-zà-ÿ])\1\1|\b[a-zà-ÿ][@$*+!|€0-9]+")
_VEILED = re.compile(r"(?<!\w)[a-zà-ÿ$@][\w$@*+!|€.-]*[\w$@*+|€!](?!\w)")
_BLANKS = re.compile(r"[ \t]{2,}|\t")
_STRETCHED = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<![\w'’])[a-zà-ÿ](?: [a-zà-ÿ]){2,}(?![\w'’])")
_SINGLE = frozenset("bcdfghjklmnpqrstuvwxz")
_LEET = str.maketrans("01345789$@!+|€", "oieastbgsaitle")
_LONGEST = max(map(len, _LEXICON))


def _lexical(word: str) -> bool:
    return word in _LEXICON or len(word) > 4 and bool(classes_of(word) & {"insult", "degrading", "profane", "sexual", "slur"})


@lru_cache(maxsize=1 << 18)
def unveil(token: str) -> str | None:
    """The lexicon's word that a token hides by digits, marks, stretching or separators, if it does."""
    if not any(c.isalpha() for c in token) or _lexical(token):
        return None
    stripped = regex.sub(r"[._\-]", "", token)
    for form in (stripped, stripped.translate(_LEET), stripped.replace("!", "l").replace("1", "l").translate(_LEET)):
        for word in (form, regex.sub(r"(.)\1{2,}", r"\1\1", form), regex.sub(r"(.)\1+", r"\1", form), regex.sub(r"(.)\1{2,}", r"\1", form)):
            if word != token and 2 < len(word) <= _LONGEST + 5 and _lexical(word):
                return word
    if "*" in stripped and len(stripped) > 3 and stripped[0] != "*":
        shape = regex.compile(regex.escape(stripped.translate(_LEET)).replace(r"\*", r"\p{L}"))
        return next((w for w in sorted(_LEXICON) if shape.fullmatch(w)), None)
    return None


@lru_cache(maxsize=1)
def _idioms():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for idiom in IDIOMS.split("|"):
        machine.add_word(idiom.strip(), len(idiom.strip()))
    machine.make_automaton()
    return machine


def has_idiom(passage: str) -> bool:
    """Whether an idiom stands in a passage, not within other words."""
    for end, size in _idioms().iter(passage):
        before, after = passage[max(0, end - size) : end - size + 1], passage[end + 1 : end + 2]
        if not (end + 1 > size and before.isalnum()) and not after.isalnum():
            return True
    return False


_SEEN: set[str] = set()
_BRIGHT: set[str] = set()


def _dull(words: list[str]) -> bool:
    """Whether no word of a passage can make a voter vote. Words are looked at once, numbers not at all."""
    unknown = set(words) - _SEEN
    if unknown:
        if len(_SEEN) > PLAIN_WORDS:
            _SEEN.clear()
            _BRIGHT.clear()
            unknown = set(words)
        for w in unknown:
            if w[0] not in _ASCII_DIGITS:
                _SEEN.add(w)
                if _LETTER[w] in _SIGNAL or not _RAREST.isdisjoint(re.split("['’-]", w)):
                    _BRIGHT.add(w)
    if _BRIGHT.isdisjoint(words):
        return True
    # The German article is no verb.
    return "die" in words and not _GERMAN.isdisjoint(words) and _BRIGHT.isdisjoint(w for w in words if w != "die")


def _flat(text: str) -> str | None:
    """A Latin text with blanks in place of what isn't in words, so that words are what blanks part; else None."""
    try:
        text = text.replace("’", "'").encode("latin-1").translate(_FLAT).decode("latin-1")
    except UnicodeEncodeError:
        return None
    return text.replace(" '", " ").replace("' ", " ").replace(" -", " ").replace("- ", " ")


class Reader:
    """Passages of texts, their words and votes."""

    def __init__(self) -> None:
        self.canon = Canon({})
        self.plain: set[str] = set()

    def passages(self, text: str) -> Iterator[tuple[str, list[str], int]]:
        """Passage in lower case, words with hidden ones shown, number of hidden ones."""
        if not text.isascii():
            text = self.canon.text(text)[0]
        text = text.lower()
        hints = self._hints(text)
        if hints:
            text = _BLANKS.sub(" ", text)
        for end in _ENDS if text.isascii() else _ENDS + _WIDE_ENDS:
            text = text.replace(end, _CUT)
        flat = None if hints else _flat(text)
        for passage in (text if flat is None else flat).split(_CUT):
            if flat is not None:
                words, hidden = passage.split(), 0
            elif any(h in passage for h in hints):
                passage, words, hidden = self.read(passage)
            else:
                words, hidden = _TOKEN.findall(passage), 0
            if len(words) <= WINDOW:
                if words:
                    yield passage, words, hidden
            else:
                for at in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                    part = words[at : at + WINDOW]
                    yield " ".join(part), part, hidden

    def _hints(self, text: str) -> list[str]:
        """Strings of the text that hide a word. Words seen to be plain aren't looked at again."""
        new = set(text.split())
        hints = [m[0] for m in _SPACED.finditer(text) if self.read(m[0])[2]] if not new.isdisjoint(_SINGLE) else []
        new -= self.plain
        if new:
            odd = [w for w in new if _HINT.search(w) and self.read(w)[2]]
            hints += odd
            if len(self.plain) > PLAIN_WORDS:
                self.plain.clear()
            self.plain.update(new.difference(odd))
        return hints

    @staticmethod
    def read(passage: str) -> tuple[str, list[str], int]:
        """A passage in lower case that may hide words."""
        hidden = 0
        if _SPACED.search(passage):
            joined = _SPACED.sub(lambda m: m[0].replace(" ", ""), passage)
            if any(map(_lexical, _TOKEN.findall(joined))) and not any(map(_lexical, _TOKEN.findall(passage))):
                hidden, passage = 1, joined

        def show(m: re.Match) -> str:
            nonlocal hidden
            if m[0].isalpha() and not _STRETCHED.search(m[0]):
                return m[0]
            word = unveil(m[0])
            hidden += word is not None
            return word or m[0]

        passage = _VEILED.sub(show, passage)
        return passage, _TOKEN.findall(passage), hidden

    @staticmethod
    def votes(_: str, words: list[str], hidden: int) -> int:
        """A bit for each voter that votes."""
        if not hidden and _dull(words):
            return 0
        letters, passage = class_string(words), " ".join(words)
        there, own = set(letters), set(words)
        idiom, alike = has_idiom(passage), bool(_ALIKE.search(passage))
        if not hidden and not idiom and not alike and there.isdisjoint(_SIGNAL):
            return 0
        about = {name: len(own & listed) for name, listed in _ABOUT.items()}
        cast = {name: bool(p.search(letters)) for name, p in _PATTERNS.items()} | {
            "insult": "N" in there or "A" in there,
            "profane": "P" in there,
            "sexual": "S" in there,
            "slur": "L" in there,
            "hidden": bool(hidden),
            "idiom": idiom,
            "alike": alike,
            "technical": about["technical"] >= 2,
            "care": about["care"] >= 1,
            "reporting": about["reporting"] >= 1,
            "sorry": about["sorry"] >= 1,
            # An insult is a person by itself.
            "impersonal": there.isdisjoint("YTGILN") and not idiom,
            # Insults that speakers say of themselves.
            "self": "I" in there and there.isdisjoint("YTGLS") and not idiom,
        }
        mask = sum(1 << k for k, name in enumerate(VOTERS) if cast[name])
        return mask if mask & ((1 << len(FOR)) - 1) else 0


class LabelModel:
    """Accuracies and correlations of voters from the counts of vote combinations, by expectation-maximisation.

    Each voter votes one way or abstains, so there are at most ``2 ** len(VOTERS)`` combinations. Voters that
    fire together more than their accuracies explain share their weight.
    """

    def __init__(self, counts: dict[int, int], prior: float = 0.3, rounds: int = 40):
        masks = [m for m in sorted(counts) if m]
        n = np.array([counts[m] for m in masks], dtype=float)
        fired = np.array([[m >> k & 1 for k in range(len(VOTERS))] for m in masks], dtype=float).reshape(-1, len(VOTERS))
        sign = np.array([1.0] * len(FOR) + [-1.0] * len(AGAINST))
        # At the start voters are believed to be right; that also fixes which of the two classes is abuse.
        self.pos = np.where(sign > 0, 0.30, 0.03)
        self.neg = np.where(sign > 0, 0.02, 0.30)
        self.prior, self.share = prior, np.ones(len(VOTERS))
        for _ in range(rounds if len(masks) else 0):
            p = self._posterior(fired)
            wp, wn = p * n, (1 - p) * n
            # Pseudo-counts keep a rare voter near where it started.
            self.pos = np.clip((wp @ fired + 3 * np.where(sign > 0, 0.30, 0.03)) / (wp.sum() + 3), 0.002, 0.995)
            self.neg = np.clip((wn @ fired + 3 * np.where(sign > 0, 0.02, 0.30)) / (wn.sum() + 3), 0.002, 0.995)
            # A voter for abuse stays one.
            self.neg = np.where(sign > 0, np.minimum(self.neg, self.pos * 0.8), np.maximum(self.neg, self.pos * 1.25))
            self.prior = float(np.clip((wp.sum() + 1) / (n.sum() + 2), 0.02, 0.98))
            rest = fired - p[:, None] * self.pos - (1 - p)[:, None] * self.neg
            cov = (rest * n[:, None]).T @ rest / n.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = cov / sd[:, None] / sd[None, :]
            together = np.clip(self.correlation - np.eye(len(VOTERS)), 0, 1)
            self.share = 1 / (1 + (together * (sign[:, None] == sign[None, :])).sum(axis=1))

    def _posterior(self, fired: np.ndarray) -> np.ndarray:
        yes = np.log(self.pos / self.neg) * self.share
        # That a voter abstains tells little: lexicons are never whole.
        no = np.log((1 - self.pos) / (1 - self.neg)) * self.share * 0.25
        logit = math.log(self.prior / (1 - self.prior)) + fired @ yes + (1 - fired) @ no
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def posterior(self, mask: int) -> float:
        return float(self._posterior(np.array([[mask >> k & 1 for k in range(len(VOTERS))]], dtype=float))[0])


def features(words: list[str], mask: int) -> list:
    """Words, pairs of words, pairs of the classes of near words and the voters of a passage; numbers count as one."""
    words = _numbers_alike(words)
    return [*words, *zip(words, words[1:]), *(class_pairs(words) if mask else ()), *voters_of(mask)]


@lru_cache(maxsize=1 << 12)
def voters_of(mask: int) -> tuple[str, ...]:
    return tuple(f"[{name}]" for k, name in enumerate(VOTERS) if mask >> k & 1)


def class_pairs(words: list[str]) -> list[str]:
    """Each class and each two classes that follow one another with at most four words between, once a passage.

    Only looked at where a voter votes."""
    letters = class_string(words)
    at = [k for k, c in enumerate(letters) if c != "."]
    signal = [k for k in at if letters[k] in _SIGNAL]
    if not signal:
        return []
    found = {f"<{letters[k]}>" for k in signal}
    for x, a in enumerate(at):
        for b in at[x + 1 :]:
            if b - a > 5:
                break
            if letters[a] in _SIGNAL or letters[b] in _SIGNAL:
                found.add(f"<{letters[a]}{letters[b]}>")
    return sorted(found)


def _numbers_alike(words: list[str]) -> list[str]:
    return ["#" if w[0] in _ASCII_DIGITS else w for w in words]


class Linear(dict):
    """A linear classifier: weights by feature, 0 for any other."""

    bias = 0.0

    def logit(self, words: list[str], mask: int) -> float:
        words = _numbers_alike(words)
        own = self.bias + sum(map(self.get, words, _ZEROS)) + sum(map(self.get, zip(words, words[1:]), _ZEROS))
        return own + (sum(map(self.get, (*class_pairs(words), *voters_of(mask)), _ZEROS)) if mask else 0.0)


def train(rows: list[tuple[list[str], int, float, float]], rounds: int = 12, decay: float = 2e-5, seed: int = 3) -> Linear:
    """Logistic regression on ``(words, mask of voters, posterior, weight)`` by adaptive gradient steps."""
    index: dict = {}
    seen: dict = {}
    coded = []
    for words, mask, _, _ in rows:
        own = features(words, mask)
        coded.append(own)
        for f in own:
            seen[f] = seen.get(f, 0) + 1
    for f, n in seen.items():
        if n > 1 or isinstance(f, str):
            index[f] = len(index)
    ids = [np.array([index[f] for f in own if f in index], dtype=np.int64) for own in coded]
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat, ends = np.concatenate([*ids, np.zeros(0, np.int64)]), np.cumsum(sizes)
    goal, weight = (np.array([r[k] for r in rows], dtype=float) for k in (2, 3))
    w, g, bias, gb = np.zeros(len(index)), np.full(len(index), 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            some = order[first : first + BATCH]
            row = np.repeat(np.arange(len(some)), sizes[some])
            offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
            at = flat[(ends[some] - sizes[some])[row] + offset]
            z = bias + np.bincount(row, w[at], len(some))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal[some]) * weight[some]
            grad = e[row] + decay * w[at]
            np.add.at(g, at, grad * grad)
            np.subtract.at(w, at, 0.3 * grad / np.sqrt(g[at]))
            gb += float(e @ e)
            bias -= 0.3 * float(e.sum()) / math.sqrt(gb)
    model = Linear({f: float(w[k]) for f, k in index.items() if abs(w[k]) > LEAST_WEIGHT})
    model.bias = bias
    return model


def cleaned(rows: list, unjudged: set[int], clued: set[int]) -> list:
    """The rows without those that a classifier trained on the other half of the rows contradicts: of those taken for
    harmless that nobody judged (``unjudged``, by place) the ones found abusive, and then of those that only a clue in
    one document speaks for (``clued``) the ones whose words speak for harmlessness. Unknown words contradict nothing."""
    half = [zlib.crc32(" ".join(words).encode()) & 1 for words, *_ in rows]
    left = set(range(len(rows)))
    for doubtful, abusive in ((unjudged, False), (clued, True)):
        if doubtful:
            models = [train([rows[k] for k in sorted(left) if half[k] != h]) for h in (0, 1)]
            for k in doubtful:
                model = models[half[k]]
                logit = model.logit(rows[k][0], rows[k][1])
                if logit < model.bias if abusive else logit >= 0:
                    left.discard(k)
    return [rows[k] for k in sorted(left)]


def _kinds() -> list:
    """Passages without votes, with some for abuse, with others only."""
    abuse = F.col("mask").bitwiseAND(_FOR_MASK) > 0
    return [F.col("mask") == 0, (F.col("mask") > 0) & abuse, (F.col("mask") > 0) & ~abuse]


def judgements(review_labels: DataFrame) -> DataFrame:
    """``doc_id, net, n``: judgements of abuse less those of harmlessness, and all; a repeated judgement counts once."""
    votes = review_labels.filter("doc_id is not null and abusive is not null").select("doc_id", "rater", "abusive").distinct()
    return votes.groupBy("doc_id").agg(F.sum(F.when(F.col("abusive") > 0, 1).otherwise(-1)).alias("net"), F.count("*").alias("n"))


def evidence_of(judged: DataFrame) -> float:
    """How much one judgement tells, as a logit, from how often two of a document differ; at least 1."""
    pairs = judged.filter("n = 2").agg(F.count("*").alias("n"), F.count(F.when(F.col("net") == 0, 1)).alias("apart")).first()
    # Without pairs a judgement is taken to be wrong one time in ten.
    apart = min((pairs.apart + 1.8) / (pairs.n + 10), 0.49)
    wrong = (1 - math.sqrt(1 - 2 * apart)) / 2
    return min(max(math.log((1 - wrong) / wrong), 1.0), MOST_EVIDENCE)


class Detector:
    """The trained detector over ``documents`` (``doc_id, text`` and what else there is), with reviewers' judgements on
    some of them (``doc_id, rater, abusive``) if there are any.

    Texts are read once: their passages, words and votes are written, and training and scoring go on from there.
    """

    def __init__(self, documents: DataFrame, stage: Stage | None = None, review_labels: DataFrame | None = None):
        self.stage = stage or Stage(documents.sparkSession)
        self.documents, self.read = documents, self.stage.put(self._read(documents))
        voted = self.read.filter(F.exists("__masks", lambda m: m > 0)).select(F.explode("__masks").alias("mask")).filter("mask > 0")
        self.labels = LabelModel({r.mask: r.n for r in voted.groupBy("mask").agg(F.count("*").alias("n")).collect()})
        each = self._each(self.read)
        offered = each.filter((F.col("mask") > 0) | (F.pmod(F.xxhash64("p"), F.lit(UNVOTED_PART)) == 0))
        own = [self._sample(offered.filter(kind).groupBy("passage").agg(F.min("mask").alias("mask"))) for kind in _kinds()]
        self.judged, rows, unjudged, clued = None, [], set(), set()
        if review_labels is not None:
            self.judged = self.stage.put(judgements(review_labels))
            self.evidence = evidence_of(self.judged)
            rows, clued = self._reviewed()
        seen = {" ".join(words) for words, *_ in rows}
        for r in itertools.chain(*own):
            if r.passage not in seen:
                posterior = self.labels.posterior(r.mask) if r.mask else 0.0
                # That no voter votes says less than that voters are sure of harmlessness.
                if words := r.passage.split():
                    if self.judged is not None and not r.mask:
                        unjudged.add(len(rows))
                    rows.append((words, r.mask, posterior, 0.3 + 1.4 * abs(posterior - 0.5) if r.mask else UNVOTED_WEIGHT))
        self.model = train(cleaned(rows, unjudged, clued))

    @staticmethod
    def _each(read: DataFrame, *keep: str) -> DataFrame:
        """Each passage, as it is and with all numbers alike, and its votes."""
        zipped = F.arrays_zip(F.split("__passages", _CUT).alias("p"), F.col("__masks").alias("m"))
        passage = F.regexp_replace("x.p", "[0-9]+", "0")
        return read.select(*keep, F.explode(zipped).alias("x")).select(*keep, "x.p", passage.alias("passage"), F.col("x.m").alias("mask")).filter("passage != ''")

    @staticmethod
    def _sample(one: DataFrame, most: int = MAX_TRAIN, *first) -> list:
        """Equal passages come once; of more than may be used those with the smallest hashes."""
        return one.orderBy(*first, F.xxhash64("passage"), "passage").limit(most).collect()

    def _reviewed(self) -> tuple[list, set[int]]:
        """Rows for training from the reviewed documents, and the places of those that only a clue in one document speaks for."""
        sided = self.judged.filter("net != 0").select("doc_id", (F.col("net") > 0).alias("abusive"))
        found = self.stage.put(self._each(self.read.join(sided, "doc_id"), "doc_id", "abusive").drop("p").distinct())
        sides = [F.count(F.when(F.col("abusive") == side, 1)).alias(name) for side, name in ((True, "bad"), (False, "fine"))]
        words = F.split("passage", " ")
        pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, k: F.concat_ws(" ", F.get(words, k), w))
        every = found.select("doc_id", "abusive", F.explode(F.array_distinct(F.concat(words, pairs))).alias("clue"))
        of = lambda df, name: df.groupBy("clue").agg(F.countDistinct("doc_id").alias(name))
        often = self.stage.put(of(every.filter("abusive"), "bad").filter(F.col("bad") >= CLUE_DOCUMENTS))
        fine = of(every.filter("not abusive").join(broadcast_if_small(often.select("clue")), "clue", "left_semi"), "fine")
        # The document itself doesn't count.
        clues = often.join(fine, "clue", "left").filter(F.col("bad") - 1 >= CLUE_PART * (F.col("bad") - 1 + F.coalesce("fine", F.lit(0))))
        strong = {r.clue for r in clues.orderBy(F.desc("bad"), "clue").limit(MAX_CLUES).select("clue").collect()}
        one = self.stage.put(found.groupBy("passage").agg(F.max("mask").alias("mask"), *sides))
        rows, clued, harmless = [], set(), (F.col("fine") > 0) & (F.col("fine") >= 0.5 * F.col("bad"))
        for r in self._sample(one.filter(~harmless)):
            words = r.passage.split()
            if not strong.isdisjoint(words) or not strong.isdisjoint(map(" ".join, zip(words, words[1:]))):
                if r.bad < 2 and not r.mask & _FOR_MASK:
                    clued.add(len(rows))
                rows.append((words, r.mask, 0.9, 1.0))
            elif r.mask & _FOR_MASK:
                rows.append((words, r.mask, 0.72, 1.0))
        weight = F.least("fine", F.lit(5))
        rows += [(r.passage.split(), r.mask, 0.0, 2.0 * min(r.fine, 5)) for r in self._sample(one.filter(harmless & (F.col("mask") > 0)), MAX_TRAIN, weight.desc())]
        rows += [(r.passage.split(), 0, 0.0, float(min(r.fine, 5))) for r in self._sample(one.filter(harmless & (F.col("mask") == 0)), MAX_TRAIN, weight.desc())]
        self.stage.drop(found, often, one)
        return rows, clued

    @staticmethod
    def _read(documents: DataFrame) -> DataFrame:
        """``documents`` with ``__passages``, words parted by blanks and passages by zeros, and ``__masks``, the votes on
        each, in place of the text."""
        rest = [c for c in documents.columns if c not in ("text", "__passages", "__masks")]
        schema = StructType([*documents.select(*rest).schema.fields, StructField("__passages", StringType()), StructField("__masks", ArrayType(IntegerType()))])

        def run(batches):
            reader = Reader()
            for batch in batches:
                flats, masks = [], []
                for text in batch.column("__text").to_pylist():
                    found = list(reader.passages(text)) if text else []
                    flats.append(_CUT.join([" ".join(words) for _, words, _ in found]))
                    masks.append([reader.votes(*x) for x in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(flats, pa.string()), pa.array(masks, pa.list_(pa.int32()))], names=schema.names)

        return documents.select(*rest, F.col("text").alias("__text")).mapInArrow(run, schema)

    def scores(self, documents: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, ``score`` of every document; 0 for null, empty and blank texts."""
        rows = self.read if documents is self.documents else self._read(documents)
        if self.judged is None:
            return self._texts_scores(rows, keep)
        net = self.judged.select(F.col("doc_id").alias("__doc_id"), F.col("net").alias("__net"))
        texts = self._texts_scores(rows.withColumn("__doc_id", F.col("doc_id")), [*keep, "__doc_id"])
        odds = F.col("score") / (1 - F.col("score")) * F.exp(F.coalesce("__net", F.lit(0)) * self.evidence)
        # The score of a text without words stays 0.
        return texts.join(net, "__doc_id", "left").select(*keep, F.when(F.col("__net").isNull(), F.col("score")).otherwise(odds / (1 + odds)).alias("score"))

    def _texts_scores(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The scores by the texts alone."""
        weights, bias = dict(self.model), self.model.bias
        schema = StructType(rows.select(*keep).schema.fields).add("score", DoubleType())

        def run(batches):
            model = Linear(weights)
            model.bias = bias
            for batch in batches:
                scores = []
                for flat, masks in zip(batch.column("__passages").to_pylist(), batch.column("__masks").to_pylist()):
                    worst = max(map(model.logit, map(str.split, flat.split(_CUT)), masks), default=None) if masks else None
                    scores.append(0.0 if worst is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, worst)))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=schema.names)

        return rows.select(*keep, "__passages", "__masks").mapInArrow(run, schema)


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, abusive, rate``, spellings of a source taken together; null sources are one row."""
    abusive = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    rows = scored.groupBy(source_key(F.col("source")).alias("source"))
    return rows.agg(F.count("*").alias("documents"), abusive.alias("abusive"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))


def agreement(scored: DataFrame, review_labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``reviewed, detected, documents``: the detector against the reviewers' majority; ties are left out.

    A repeated judgement counts once.
    """
    votes = review_labels.filter("doc_id is not null and abusive is not null").select("doc_id", "rater", "abusive").distinct()
    majority = votes.groupBy("doc_id").agg(F.avg("abusive").alias("share")).filter("share != 0.5")
    both = majority.join(scored.select("doc_id", "score"), "doc_id")
    return both.groupBy((F.col("share") > 0.5).alias("reviewed"), (F.col("score") >= threshold).alias("detected")).agg(F.count("*").alias("documents"))
