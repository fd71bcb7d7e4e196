"""Word classes of the abuse grammar: stems by language and the rules that inflect them."""

from __future__ import annotations

from functools import lru_cache

# Stems by class and language; a figure after a colon is the weight of all that follow, 1 at first.
NOUNS: dict[str, dict[str, str]] = {
    "INSULT": {
        "en": "idiot imbecile moron cretin halfwit dimwit nitwit numbskull numskull nincompoop buffoon dunce dullard simpleton blockhead bonehead scumbag scum dirtbag douchebag lowlife bastard bitch whore slut skank hussy arsehole asshole prick wanker tosser twat cunt scoundrel pervert "
        "degenerate sewer-rat maggot parasite leech vermin swine weasel bellend git retard loser pig-dog arse imbecilic freak psycho filth slime lowlives trash garbage :0.8 coward fool clown jerk creep liar traitor rat pig snake toad worm cockroach cow hag :0.6 dog animal goat",
        "es": "imbécil idiota gilipollas cabrón hijoputa capullo subnormal tarado payaso canalla mamón pendejo puta zorra basura escoria mentiroso cobarde desgraciado malnacido sinvergüenza inútil :0.8 cerdo rata perro gusano burro",
        "fr": "connard connasse salaud salope ordure enculé imbécile crétin abruti débile bâtard pétasse putain pute raclure enfoiré pourriture menteur menteuse lâche idiot idiote conne :0.8 porc rat chien cafard vermine",
        "de": "arschloch idiot trottel depp vollidiot mistkerl schweinehund drecksack drecksau wichser hurensohn schlampe hure fotze missgeburt versager dummkopf schwachkopf lügner feigling abschaum penner spast :0.8 schwein ratte hund sau esel ziege",
    },
    "GROUP": {
        "en": "immigrant migrant refugee foreigner jew muslim christian hindu arab african asian mexican gypsy black gay lesbian homosexual transsexual woman feminist peasant foreigner minority outsider",
        "es": "inmigrante migrante refugiado extranjero judío musulmán moro árabe gitano negro homosexual maricón mujer feminista",
        "fr": "immigré migrant réfugié étranger juif musulman arabe gitan noir homosexuel femme féministe",
        "de": "ausländer einwanderer migrant flüchtling jude moslem muslim araber zigeuner schwule homosexuelle frau feministin",
    },
    "DEHUMAN": {"en": "disease animal vermin plague parasite scum cancer subhuman savage filth rat cockroach pest virus beast monster pig dog trash garbage", "es": "plaga animal parásito escoria rata basura cáncer bestia", "fr": "parasite vermine animal cancer cafard peste rat sous-homme", "de": "ungeziefer parasit pest tier untermensch abschaum krankheit ratte"},
    "PEST": {"en": "rat fly roach cockroach vermin rabbit insect louse maggot flies lice", "es": "rata conejo cucaracha", "fr": "rat lapin cafard mouche", "de": "ratte karnickel ungeziefer"},
    "CRIME": {"en": "thief thieves liar criminal murderer rapist crook", "es": "ladrón criminal asesino", "fr": "voleur criminel menteur", "de": "dieb verbrecher lügner"},
    "BODY": {
        "en": "finger tooth teeth neck leg throat face bone head skull knee kneecap arm hand eye belly gut back jaw nose skin", "es": "cara cuello diente pierna hueso cabeza boca", "fr": "gueule cou dent jambe os tête gorge", "de": "hals zahn bein knochen schädel fresse kopf genick",
    },
    "KIN": {"en": "family child children kid wife husband mother father son daughter sister brother house home car dog", "es": "familia hijo madre mujer casa", "fr": "famille enfant mère femme maison", "de": "familie kind mutter frau haus"},
    "MOUTH": {"en": "mouth face trap gob pie-hole", "es": "boca hocico", "fr": "gueule bouche", "de": "maul klappe fresse"},
    "GRAVE": {"en": "ground grave hospital morgue earth coffin hole wheelchair", "es": "tumba hospital cementerio", "fr": "tombe hôpital cercueil", "de": "grab krankenhaus sarg"},
    "LIKENESS": {"en": "picture photo pic selfie video image photograph clip", "es": "foto vídeo video imagen", "fr": "photo vidéo image", "de": "foto bild video"},
    "NUDES": {"en": "nudes", "es": "desnudos", "fr": "nudes", "de": "nacktbild nacktfoto nacktbilder nacktfotos"},
    "GENITAL": {"en": "cock dick pussy tit boob clit cunt balls", "es": "polla coño teta verga", "fr": "bite nichon", "de": "schwanz muschi titte fotze"},
    "BEDROOM": {"en": "bed bedroom mattress sheets", "es": "cama", "fr": "lit", "de": "bett"},
    "HELL": {"en": "hell", "es": "infierno", "fr": "enfer", "de": "hölle"},
    "SHIT": {"en": "shit crap", "es": "mierda", "fr": "merde", "de": "scheiße scheisse dreck"},
}
ADJECTIVES: dict[str, dict[str, str]] = {
    "ADJ": {
        "en": "worthless pathetic disgusting spineless brainless gutless two-faced slimy repulsive wretched contemptible despicable vile fucking goddamn goddamned fuckin useless cowardly good-for-nothing bloody-minded :0.9 filthy lying stinking greasy rotten stupid miserable hateful shitty crappy sick :0.7 dirty fat lazy ugly dumb ignorant bloody damn damned poor little old",
        "es": "repugnante asqueroso puto maldito miserable patético despreciable inútil podrido jodido :0.8 sucio gordo estúpido",
        "fr": "sale gros pauvre dégoûtant minable pathétique misérable infect pourri putain :0.8 petit vieux stupide",
        "de": "dreckig verdammt elend erbärmlich widerlich wertlos feig verlogen verkommen scheiß :0.8 dumm blöd fett faul dumme blöde blöder dummer hässlich",
    },
    "NUDE": {"en": "naked nude topless undressed", "es": "desnudo", "fr": "nu", "de": "nackt"},
    "STUPID": {"en": "stupid dirty dumb evil filthy inferior primitive backward lazy violent", "es": "tonto estúpido sucio", "fr": "bête stupide sale", "de": "dumm dreckig blöd"},
}
VERBS: dict[str, dict[str, str]] = {
    "VIOLENT": {
        "en": "kill murder strangle stab drown slaughter butcher behead castrate rape torture choke gas lynch execute shoot smash crush slit bury hurt beat destroy skin gut hang poison burn break cut tear rip punch kick snap",
        "es": "matar asesinar degollar estrangular destrozar reventar apuñalar violar quemar partir romper machacar rajar", "fr": "tuer égorger étrangler massacrer buter crever défoncer violer brûler casser planter péter",
        "de": "umbringen töten ermorden abstechen erwürgen vergewaltigen totschlagen erschießen kaltmachen fertigmachen aufschlitzen zerquetschen brechen verprügeln anzünden niederbrennen",
    },
    "KILL": {"en": "kill murder strangle stab drown slaughter butcher behead castrate rape torture gas lynch shoot hurt bury destroy hang skin gut beat execute", "es": "matar asesinar degollar estrangular destrozar reventar apuñalar violar quemar machacar rajar", "fr": "tuer égorger étrangler massacrer buter crever défoncer violer planter", "de": "umbringen töten ermorden abstechen erwürgen vergewaltigen totschlagen erschießen kaltmachen fertigmachen aufschlitzen verprügeln"},
    "SUFFER": {"en": "die rot bleed burn choke perish", "es": "morir pudrir sufrir", "fr": "crever mourir pourrir souffrir", "de": "sterben verrecken krepieren verrotten leiden"},
    "FUCK": {"en": "fuck screw bang shag", "es": "follar joder coger chingar", "fr": "baiser niquer enculer", "de": "ficken bumsen vögeln"},
    "SUCK": {"en": "suck lick ride stroke sucked licked stroked sucking licking riding", "es": "chupar lamer mamar", "fr": "sucer lécher", "de": "lutschen lecken blasen"},
    "SEND": {"en": "send show text mail", "es": "enviar mandar enseñar", "fr": "envoyer montrer", "de": "schicken senden zeigen"},
    "BREED": {"en": "breed multiply spawn reproduce", "es": "reproducir multiplicar", "fr": "reproduire multiplier", "de": "vermehren"},
    "THROW": {"es": "echar matar expulsar deportar fusilar exterminar quemar ahorcar", "fr": "expulser jeter chasser virer tuer fusiller pendre exterminer éliminer gazer brûler", "de": "jagen vergasen abschieben erschießen ausrotten aufhängen rausschmeißen rauswerfen verjagen vernichten töten werfen"},
}
WORDS: dict[str, str] = {
    "YOU": "you u ya ye du ihr tú tu vous vosotros usted ustedes vos thou you're youre ur u're t'es",
    "OBJ": "you u ya thee dich euch te os toi vous dir",
    "YOUR": "your yer ur dein deine deinen deinem deiner dein' tu tus ton ta tes votre vos vuestra vuestro eure euren",
    "SELF": "yourself yourselves urself herself himself dich te toi",
    "I": "i we i'll we'll i'm we're i'd ich wir je j' on yo nosotros",
    "ILL": "i'll we'll",
    "ME": "me mir us nous moi m' my mich",
    "MY": "my mi mein meinen meine mon ma mes",
    "HIM": "him her them me us ihn sie lo la los las",
    "BE": "are is be am being been ser être eres es sois son estáis bist seid sind ist wart sein es êtes est sont n'es were you're youre t'es u're i'm we're was",
    "WILL": "will gonna gon shall should'll i'll we'll you'll voy vamos va vas vais werde werden vais va wirst wird werdet",
    "GOING": "going want wanna plan swear promise quiero queremos will wollen veux voulons",
    "TO": "to a zu de",
    "DET": "a an the such un une una unos unas ein eine einen einem einer das der die le la les des el los las another some dieser",
    "THESE": "these those that this esos esas estos estas ese esa ces ce cet cette diese dieser dieses solche solches",
    "ALL": "all every each todos todas tous toutes alle allen jeden",
    "ADV": "really just nothing but complete completely total totally utter utterly absolute absolutely such so fucking qu'un qu'une qu’un qu’une que nur doch ja bloß tan muy más vraiment tellement so richtig wirklich endlich always again still ever only pathological ganz einfach completo total sacré sacrée espèce goddamn damn",
    "NEG": "not never no isn't aren't wasn't weren't don't won't wouldn't cannot can't n't neither nicht nie niemals kein keine keinen jamás nunca pas jamais aucun ni",
    "NOBODY": "nobody noone no-one none niemand nadie personne keiner",
    "MISS": "miss want wants likes loves needs misses vermisst vermissen braucht mag echará extrañará quiere regrettera aime",
    "SHOULD": "should must ought habría habria hay deberían deberian debería tendrían devraient devrait doivent doit faut faudrait sollte sollten muss müssen gehören gehört deserve deserves need needs belong",
    "OUTS": "wiped exterminated gassed hanged shot eradicated purged lynched slaughtered executed sterilised sterilized deported burned burnt drowned killed expelled castrated enslaved driven shipped locked thrown put rounded jetés expulsés chassés virés tués gazés fusillés pendus jetées expulsées rausgeworfen",
    "EACHONE": "them einzelne lot last todos tous alle",
    "ONE": "one single everyone",
    "OF": "of",
    "SHUT": "shut cierra cállate callate ferme fermez ferme-la ta halt halts haltet halt's hold cerrad callaos",
    "UP": "up la boca gueule",
    "HOPE": "hope wish pray espero ojalá ojala j'espère espère hoffe hoffentlich wünsche may",
    "DIEYOU": "mueras muráis pudras pudráis mueran crèves creves stirbst krepierst verreckst sterbt mátate matate suicide-toi pends-toi verrecke verreck verreckt stirb krepier krepiere muérete muere pendez-vous",
    "GO": "go geh geht vete va allez vas ve andate lárgate",
    "CRAWL": "crawl slither scuttle",
    "BACK": "back",
    "UNDER": "under into from beneath below",
    "JUMP": "jump hang kill shoot drown cut",
    "OFF": "off yourself out",
    "HIGH": "bridge cliff roof building crane pier tower train ledge window",
    "RATHER": "favour favor dead alive gone",
    "CAPACITY": "only just solo sólo seulement que nur",
    "GOODFOR": "good belong fit buenas sirven bonnes taugen gut",
    "PLACE": "bedroom kitchen backs knees cocina cama cuisine lit küche bett bed lying",
    "LIKE": "like como comme wie",
    "BY": "by por de von per",
    "BLOOD": "blood birth nature breeding sangre naturaleza naissance sang geburt natur",
    "HUMAN": "human humans humanos humains menschen people",
    "ALLOWED": "allowed permitted let",
    "TOO": "too demasiado trop zu",
    "TYPICAL": "typical típico típica typique typisch typischer bloody fucking",
    "RAUS": "raus fuera dehors out",
    "DEATH": "death muerte mort tod muera mueran",
    "HATE": "hate despise odio detesto hais hasse loathe",
    "DESERVE": "deserve deserves merecen méritent verdienen verdient mérite merece",
    "COUNTRY": "country came país land pays kamst",
    "FUCKYOU": "fuck fick screw jódete jodete nique bugger damn verpiss leck",
    "OFFYOU": "off you yourself dich u mich te ta tu",
    "FOUTRE": "foutre culo culer mierda jodan chingada ficken",
    "THINK": "thinking dreaming think dream imagine imagining fantasising fantasizing picture picturing pienso sueño pense rêve denke träume",
    "ABOUT": "of about en à an von",
    "TOUCHING": "touching fingering rubbing stroking pleasuring tocándote touche anfassen masturbating masturbándote",
    "MOAN": "moaning moan moaned gasping groaning panting gimiendo gémir stöhnen",
    "ROUGH": "rough hard wild hot dirty anal oral kinky",
    "SEX": "sex sexo sexe",
    "HAVE": "had have having has hatten tuvimos",
    "SPREAD": "spread open",
    "LEGS": "legs piernas jambes beine",
    "ONTO": "onto into on sur sobre auf ins",
    "PULL": "pulled dragged pushed threw pinned laid pulls drags",
    "SWEAT": "sweating sweaty writhing panting naked nude undressed topless moaning",
    "PUT": "put bury send lay leave bring mettre",
    "IN": "in under into to six on",
    "KNOW": "know sé sais weiß weiss",
    "WHERE": "where dónde donde où wo",
    "LIVE": "live lives sleep vives habites wohnst kids",
    "WATCH": "watch cuida surveille pass",
    "DEAD": "dead finished toast muerto muertos mort morts tot fertig erledigt",
    "FOR": "for por pour für",
    "REPORT": "said says stated states alleged alleges heard testified reported reports claimed claims denied denies wrote asked complained told explained noted dijo afirmó declaró negó denunció déclaré déclare affirmé nié dit behauptete sagte erklärte bestritt gab berichtete",
    "THAT": "that whether if que qu' dass ob si",
    "AND": "and y et und e",
    "HERE": "here there",
    "SLUR": "nigger niggers kike kikes faggot faggots spic spics chink chinks paki pakis tranny trannies raghead ragheads kanake kanaken youpin bougnoule sudaca",
    "CRUDE": "motherfucker motherfuckers cocksucker cocksuckers",
    "CON": "con cons",
    "ERES": "eres sois",
    "MAKE": "make makes making made haré hacer",
    "PAIN": "suffer bleed beg scream cry pay",
    "HIS": "his her their la le the",
    "WHAT": "what such qué quel quelle was für",
    "SUCKME": "chúpame chupame cómeme suce-moi",
    "KINDOF": "espèce bande pedazo hatajo panda bunch pack lot",
    "SENDME": "mándame mandame envíame enviame enséñame pásame envoie-moi envoyez-moi montre-moi",
    "VOY": "quiero queremos voy vamos",
    "CURSE": "damn curse verfluche maldigo maldito",
    "BRING": "bringe bringen mache machen schlage schlag schlagen steche",
    "UM": "um kalt fertig tot ab kaputt",
}
PREFIXES = {"de": ("drecks", "scheiß", "scheiss", "mist", "voll", "arsch", "sau", "huren", "dreck"), "en": ("shit", "dick", "fuck", "ass", "arse", "cock", "dumb", "butt", "douche", "crap")}
HEADS = {"de": ("kerl", "kopf", "weib", "stück", "pack", "bande", "schwein", "sau", "idiot", "depp", "loch", "geige", "gesicht", "fotze"), "en": ("head", "face", "hat", "wipe", "bag", "hole", "wad", "stick", "nozzle", "brain", "ass", "arse", "wit", "weasel")}


def noun_forms(w: str, lang: str) -> set[str]:
    if lang == "en":
        return {w, w + ("es" if w[-1:] in "sxz" or w[-2:] in ("ch", "sh") else "s"), *([w[:-1] + "ies"] if w[-1:] == "y" and w[-2:-1] not in "aeiou" else []), *([w[:-3] + "men"] if w.endswith("man") else [])}
    if lang == "es":
        bare = w.translate(str.maketrans("áéíóú", "aeiou"))
        stem = {w[:-1] + x for x in ("o", "a", "os", "as")} if w[-1:] in "oa" else {w + "s", w} if w[-1:] == "e" else {w, w + "es", w + "a", w + "as", bare + "es", bare + "a", bare + "as"}
        return stem | {w}
    if lang == "fr":
        return {w, w + "s", w + "e", w + "es", w + "x"}
    return {w, w + "e", w + "en", w + "n", w + "s", w + "er", w + "innen", w + "in"}


def adjective_forms(w: str, lang: str) -> set[str]:
    return {w, *(w.rstrip("e") + x for x in ("er", "e", "es", "en", "em"))} if lang == "de" else noun_forms(w, lang) if lang != "en" else {w}


def verb_forms(w: str, lang: str) -> set[str]:
    """The forms in which threats and orders are made: infinitive, first persons, future, orders; no past forms."""
    if lang == "es":
        stem = w[:-2]
        orders = {stem + x for x in (("a", "ame", "ad", "e", "en") if w.endswith("ar") else ("e", "eme", "id", "a", "an"))}
        return {w, w + "é", w + "emos", w + "án", stem + "o", stem + "amos", *orders, *(w + c for c in ("te", "os", "los", "las", "le", "lo", "la", "me", "se"))}
    if lang == "fr":
        stem = w[:-2]
        return {w, *((w + x for x in ("ai", "ons", "as", "ont")) if w.endswith(("er", "ir")) else ()), stem + "e", stem + "es", stem + "ons", stem + "e-moi", stem + "ez", stem + "ent"}
    if lang == "de":
        stem = w[:-2] if w.endswith("en") else w[:-1]
        return {w, stem + "e", stem, stem + "t", stem + "st"}
    return {w}


@lru_cache(maxsize=1)
def lexicon() -> dict[str, tuple[frozenset[str], float]]:
    """Every form with its classes and weight."""
    classes: dict[str, set[str]] = {}
    weight: dict[str, float] = {}

    def add(form: str, kind: str, w: float) -> None:
        classes.setdefault(form, set()).add(kind)
        weight[form] = min(weight.get(form, 1.0), w)

    for table, inflect in ((NOUNS, noun_forms), (ADJECTIVES, adjective_forms), (VERBS, verb_forms)):
        for kind, langs in table.items():
            for lang, listed in langs.items():
                w = 1.0
                for stem in listed.split():
                    if stem[0] == ":":
                        w = float(stem[1:])
                        continue
                    for form in inflect(stem, lang):
                        add(form, kind, w)
                    if table is VERBS and lang == "es":  # with the person addressed hung on
                        for form in (stem + "te", stem + "os"):
                            add(form, kind + "_YOU", w)
    for kind, listed in WORDS.items():
        for form in listed.split():
            add(form.replace("’", "'"), kind, 1.0)
    for form, kinds in classes.items():
        if "INSULT" not in kinds and "ADJ" not in kinds:
            weight[form] = 1.0
    return {form: (frozenset(kinds), weight[form]) for form, kinds in classes.items()}


def compound(word: str) -> bool:
    """Whether a word is an insult put together of a coarse word and a head."""
    return any(word.startswith(p) and word[len(p) :].rstrip("s") in HEADS[lang] or (lang == "de" and word.startswith(p) and word[len(p) :] in HEADS[lang]) for lang, listed in PREFIXES.items() for p in listed)
