"""Lists, tables, limits and patterns that results depend on.

They are data, kept as plain text in their natural order. Code that uses them
lives in the other modules.
"""

# ---- Fixed values: names and matching -------------------------------------------------

LEADING_ARTICLES = "el la los las un una the a an".split()
TYPE_SUFFIXES = "novela manhwa novel manga manhua comic webtoon".split()

STOP_WORDS = (
    "el la los las lo de del y e o a al en con un una por para su sus se que mi tu "
    "the of an and or to in on with his her my your is was as at by for from t s "
    "es soy son am are be i m como cuando donde porque aunque mientras si ya muy mas "
    "sobre entre hasta desde contra sin tras how what when where who why which than then this that"
).split()

FILLER_WORDS = (
    "promo promocion descubrir especial especiales oficial official raw color colored recolor remake reboot "
    "uncensored censura sincensura fanmade novela novel manhwa manhua manga webtoon comic espanol latino ingles english"
).split()

MIN_INDEX_KEY = 3          # shorter name keys are not indexed
MIN_DUPLICATE_NAME = 4     # shorter normalized names do not make duplicate pairs
MIN_CONTENT_WORDS = 4      # fewer words: no similarity match
SIMILAR_ENOUGH = 0.8       # translated titles, duplicate candidates
SIMILAR_ORIGINAL = 0.9     # original titles
MERGE_ALONE = 0.95         # at least this: merged without review
MAX_POSTINGS = 80          # a word in more titles than this does not discriminate

# ---- Fixed values: language of titles and prose ---------------------------------------

TITLE_WORDS_EN = (
    "the of an and to in is my i me you your who with from for on at as how after into since have has was were be "
    "been becomes become only not no this that his her its it their our we he she by up out all one day when what "
    "why can will just"
).split()
TITLE_WORDS_ES = (
    "el la los las de del en con mi mis un una y que por para al se su sus tu no es soy como cuando sin sobre entre "
    "hasta desde yo me te nos lo ya ser hacia"
).split()
TITLE_WORDS_OTHER = "le les des du et une aux um uma em ao do nao der die das und ein eine von zu dos ga wa wo".split()
OTHER_LATIN = r"[çãõàèìòùâêîôûëïüöäßøåæœąęłńśźżđơưşğıạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]|ów\b|nh"
ELISION = r"\b[ld]'[a-zé]"
PINYIN = (
    "^(?:(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?"
    "(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|uo|ui|ue|er|a|o|e|i|u|v))+$"
)
KOREAN_CLUSTERS = "eo|eu|jj|kk|hw|gw|oe"
ENDINGS_ES = "(?:o|a|os|as|cion|dad|mente)$"
ENDINGS_EN = "(?:ing|ings|ed|ness|ly|tion|th|ght|er|ers|or|ist|ian|ine|ure)$"
ENDINGS_FR = "(?:aire|aite|eux|eur|oir|ais|ait|ille)$"
FORMAT_WORDS = "novela novel manhwa manga webtoon".split()

PROSE_WORDS_EN = "the and of to his her is in with she for that after who but when was their from will".split()
PROSE_WORDS_ES = "el la de que y en los las su con un una por se del para al es lo como".split()
MIN_PROSE_WORDS = 12

SOURCE_WORDS_ES = (
    "que de la el los las un una con por para del al se su no pero como cuando donde sin sobre es son"
).split()
SOURCE_WORDS_EN = "the of and to in is was his her with that for from by on at as but not are this".split()

# ---- Fixed values: chapters ----------------------------------------------------------

CHAPTER_WORDS = "cap[íi]tulo|chapter|cap|ch|episodio|ep"
TITLE_PREFIX_WORDS = (
    r"cap[íi]tulo|cap[íi]tol|cap\.?|chapter|chap\.?|ch\.?|episodio|episode|ep\.?|bab|chương|kapitel|chapitre|#"
)
TRAILING_MARKS = r"novela|novel|manhwa|manhua|manga|espa(?:ñ|n)ol|latino|oficial|color|sin[- ]?censura"
MAX_LISTED_CHAPTERS = 3000
MAX_CHAPTER_NUMBER = 99_999

# ---- Fixed values: synopses -----------------------------------------------------------

CARD_PARAGRAPH = (
    r"^(?:\*?\s*(?:source|fuente)\s*:|\*\*|__|-{3,}|_{3,}|\[|[-*] \[|>"
    r"|(?:notes?|links?|nota|enlaces|official|original (?:web(?:toon|novel)|novel|manhwa|manhua|manga|work)"
    r"|also known|alternative|raws?|status)\b\s*:?)"
)
# brackets are escaped within classes and loops are possessive, as Java wants them: an ordinary loop recurses once per character
SOURCE_NOTE = (
    r"\*?\s*[(\[]\s*(?:source|from|fuente|desde)\b\s*:?(?:[^()\[\]]++|\[[^\]]*+\]|\([^)]*+\))*+[)\]]\s*\*?"
)
# pattern, replacement, in this order
PROSE_CLEANING = [
    (r"(?iu)" + SOURCE_NOTE, " "),
    (r"(?imu)\*?\s*\b(?:source|fuente)\s*:[^*\n]*\*?\s*$", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"https?://\S+", ""),
    (r"\*\*|__", ""),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"[ \t]{2,}", " "),
    (r" +([.,;:!?])", "$1"),
]

# ---- Fixed values: texts of the bulk export --------------------------------------------

PIN_TITLE_AHEAD = "{titulo}: la novela va {faltan} capítulos por delante del manhwa"
PIN_TITLE = "{titulo} — dónde leer todos los capítulos en español"
PIN_BODY_AHEAD = (
    "El manhwa va por el capítulo {manhwa} y la novela por el {novela}: te faltan {faltan} capítulos de historia. "
    "Te decimos por qué capítulo seguir y dónde leerla, gratis."
)
PIN_BODY = (
    "Todas las fuentes de {titulo} indexadas en un sitio: {total} capítulos con enlace al sitio original, "
    "y el aviso cuando sale uno nuevo."
)
PIN_ALSO = "También conocida como {otros}."
PIN_KEYWORDS = ["manhwa", "novela ligera", "dónde leer"]

# ---- Fixed values: genres ------------------------------------------------------------
# Spanish name | English name | other spellings

GENRE_TABLE = """
Acción | Action
Aventura | Adventure
Fantasía | Fantasy
Drama | Drama
Comedia | Comedy
Romance | Romance
Artes marciales | Martial Arts
Sobrenatural | Supernatural
Recuentos de la vida | Slice of Life
Vida escolar | School Life
Ciencia ficción | Sci-Fi | sci fi, scifi, science fiction
Misterio | Mystery
Psicológico | Psychological
Terror | Horror
Suspenso | Thriller | suspense
Histórico | Historical
Tragedia | Tragedy
Deportes | Sports
Mecha | Mecha
Música | Music
Crimen | Crime
Medicina | Medical
Superhéroes | Superhero
Filosófico | Philosophical
Videojuegos | Game | games, video games
Chicas mágicas | Magical Girls | mahou shoujo
Cambio de género | Gender Bender
Isekai | Isekai | transported to another world, another world, otro mundo
Harem | Harem
Ecchi | Ecchi
Seinen | Seinen
Shounen | Shounen
Shoujo | Shoujo
Josei | Josei
Wuxia | Wuxia
Murim | Murim
Regresión | Regression | regressor, returner, regresion
Reencarnación | Reincarnation | reincarnated, rebirth, renacimiento
Viaje en el tiempo | Time Travel | time manipulation
Magia | Magic | magic school, mages
Cultivo | Cultivation | xianxia, xuanhuan
Sistema | System | game system, status window, game elements
Mazmorras | Dungeon | dungeons
Supervivencia | Survival
Postapocalíptico | Post-Apocalyptic | apocalypse, apocalyptic, post apocalyptic
Monstruos | Monsters | monster, monster girls
Villana | Villainess
Nobleza | Nobility | aristocracy, royalty, realeza
Academia | Academy
Militar | Military
Cocina | Cooking | gourmet
Vampiros | Vampire | vampires
Zombis | Zombie | zombies
Protagonista OP | Overpowered MC | op mc, overpowered protagonist, overpowered main character
Venganza | Revenge
Torres | Tower
Demonios | Demons | demon
Protagonista genio | Genius MC
Protagonista loco | Crazy MC
Premiado | Award Winning
Maduro | Mature
Adulto | Adult
Hentai | Hentai
Smut | Smut
Erótico | Erotica | erotico, pornographic
Yaoi | Yaoi
Yuri | Yuri
Boys' Love | Boys' Love | bl
Girls' Love | Girls' Love | gl
Shounen Ai | Shounen Ai
Shoujo Ai | Shoujo Ai
Lolicon | Lolicon
Shotacon | Shotacon
"""
MAX_GENRES = 15

EXPLICIT_GENRES = "adulto hentai smut erotico".split()
BLOCKED_GENRES = "lolicon shotacon".split()

DEMOGRAPHIES = "Shounen Seinen Shoujo Josei".split()
ADULT_HINTS = "adulto smut hentai erotico maduro ecchi harem psicologico terror".split()
ACTION_HINTS = (
    "accion artes-marciales aventura fantasia murim wuxia regresion torres videojuegos deportes superheroes mecha "
    "isekai reencarnacion demonios venganza"
).split()
ROMANCE_HINTS = "romance drama recuentos-de-la-vida vida-escolar historico".split()

# ---- Fixed values: providers, status, covers -----------------------------------------

PROVIDER_ORDER = "anilist mangaupdates mangabaka mal".split()
NAMES_PROVIDER = "mangabaka"
FINISHED, ONGOING = "Finalizado", "En emisión"
FINISHED_WORDS = "finish|complet|finalizad"
ONGOING_WORDS = "ongoing|releasing|emis|publish|hiatus"
LAST_RESORT_HOSTS = "mangadex|imageshack"
NO_COVER = "/portadas/sin-portada.svg"
MAX_SYNOPSIS, MAX_ALTERNATIVES, MAX_API_ALTERNATIVES, MAX_API_GENRES = 4000, 15, 8, 6

# ---- Fixed values: indexing tiers and releases ---------------------------------------

MIN_CHAPTERS = 5
RELEASE_START = "2026-11-03"
RELEASE_PER_WEEK = 300
FILE_LIMIT, OTHER_FILES = 19_500, 500
URLS_PER_SHARD = 45_000
URLSET_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
URLSET_CLOSE = "</urlset>"
HUB_PAGES = [
    "/", "/en/", "/novelas/", "/series/", "/en/series/", "/rankings/", "/en/rankings/", "/novedades/", "/en/novedades/",
    "/titulos/", "/en/titulos/",
]
WORKS_PER_PAGE = 96
RELATED_WORKS = 6

# ---- Fixed values: bulk export boards ------------------------------------------------
# genre label = board

BOARD_TABLE = """
action = Manhwa de acción
acción = Manhwa de acción
adventure = Manhwa de aventura
aventura = Manhwa de aventura
fantasy = Manhwa de fantasía
fantasía = Manhwa de fantasía
romance = Manhwa romántico
drama = Manhwa romántico
martial arts = Manhwa de artes marciales
artes marciales = Manhwa de artes marciales
murim = Manhwa de artes marciales
cultivation = Manhwa de cultivo
cultivo = Manhwa de cultivo
xianxia = Manhwa de cultivo
isekai = Manhwa de regresión e isekai
regresión = Manhwa de regresión e isekai
regression = Manhwa de regresión e isekai
reencarnación = Manhwa de regresión e isekai
villainess = Manhwa de villanas
villana = Manhwa de villanas
horror = Manhwa de terror
terror = Manhwa de terror
"""
DEFAULT_BOARD = "Manhwa con novela"
PINS_PER_FILE = 200

# ---- Fixed values: listing detection -------------------------------------------------

SYSTEM_SEGMENTS = "wp-json wp-content category tag author page feed".split()
PREFERRED_SEGMENTS = "manga series comic comics manhwa novela novel".split()

# ---- Fixed values: languages of the site ---------------------------------------------

BASE_LANGUAGE = "es"
DEAD_PREFIXES = "en pt de fr it br".split()  # languages that work paths may start with
PATH_LANGUAGES = "en pt id fr de vi".split()  # languages that broken paths are repaired from
PUBLISH_COVERAGE = 0.95


# ---- Fixed values: texts of the work and equivalence pages ----------------------------
# {t} title, {m} last manhwa chapter, {n} last novel chapter, {lead} chapters ahead, {s} "3 fuentes"

PAGE_TEXTS = {
    "es": {
        "caps_manhwa": "manhwa cap. {um}",
        "caps_novela": "novela cap. {un}",
        "one": "fuente",
        "many": "fuentes",
        "both": "manhwa y novela",
        "novela": "novela",
        "gap": "El manhwa va por el capítulo {m} y la novela por el {n}: te faltan {lead} capítulos de historia. "
               "Te decimos por cuál seguir y dónde leerla.",
        "about": "{t}: {fmt}. Dónde leerla en {s}, el último capítulo de cada una y por cuál seguir.",
        "intro": "{t}{other} está disponible como {kind}.",
        "intro_sources": "Está indexada en {s}, cada una con enlace al sitio original.",
        "intro_gap": "La novela va por el capítulo {n} y el manhwa por el {m}{ahead}.",
        "intro_ahead": ": {lead} capítulos por delante",
        "q_where": "¿Dónde leer {t}?",
        "a_where": "Está indexada en {s} ({names}). Cada una enlaza al sitio original donde se lee gratis.",
        "q_count": "¿Cuántos capítulos tiene {t}?",
        "a_count": "El manhwa lleva {m} capítulos indexados y la novela {n}{ahead}.",
        "count_ahead": ", {lead} por delante del manhwa",
        "q_spoil": "¿Puedo leer la novela de {t} sin spoilers del manhwa?",
        "a_spoil": "Sí: empieza por el capítulo de la novela que corresponde a donde dejaste el manhwa. Lo que la novela te "
                   "adelanta es lo que el manhwa aún no ha dibujado, no lo que ya leíste.",
        "q_done": "¿{t} está terminada?",
        "a_done": "Sí, {t} está finalizada.",
        "a_open": "No, {t} sigue en emisión y recibe capítulos nuevos.",
        "eq_title": "{t}: ¿por qué capítulo de la novela sigo? — Manhwa {m} → Novela {n}",
        "eq_heading": "¿Por qué capítulo de la novela sigo {t}?",
        "eq_ahead": "El manhwa de {t} va por el capítulo {m} y la novela por el {n}: hay {lead} capítulos de historia que el "
                    "manhwa todavía no ha contado.",
        "eq_level": "El manhwa de {t} va por el capítulo {m} y la novela por el {n}: el manhwa está prácticamente al día con "
                    "la novela.",
        "eq_q_next": "¿En qué capítulo de la novela continúa el manhwa de {t}?",
        "eq_q_count": "¿Cuántos capítulos tiene la novela de {t}?",
        "eq_a_count": "La novela lleva {n} capítulos indexados y el manhwa {m}.",
        "eq_q_spoil": "¿Leer la novela de {t} tiene spoilers del manhwa?",
        "eq_a_spoil": "Si empiezas por el capítulo que corresponde a donde dejaste el manhwa, no. Lo que se salta el manhwa está "
                      "por delante, no por detrás: la novela solo te adelanta lo que el manhwa aún no dibujó.",
    },
    "en": {
        "caps_manhwa": "manhwa ch. {um}",
        "caps_novela": "novel ch. {un}",
        "one": "source",
        "many": "sources",
        "both": "manhwa and novel",
        "novela": "novel",
        "gap": "The manhwa is at chapter {m} and the novel at {n}: {lead} chapters of story ahead. See which novel chapter to "
               "continue from and where to read it.",
        "about": "{t}: {fmt}. Where to read it across {s}, the latest chapter on each and where to continue.",
        "intro": "{t}{other} is available as {kind}.",
        "intro_sources": "It is indexed on {s}, each one linking to the original site.",
        "intro_gap": "The novel is on chapter {n} and the manhwa on chapter {m}{ahead}.",
        "intro_ahead": ": {lead} chapters ahead",
        "q_where": "Where can I read {t}?",
        "a_where": "It is indexed on {s} ({names}). Each one links to the original site where it is free to read.",
        "q_count": "How many chapters does {t} have?",
        "a_count": "The manhwa has {m} chapters indexed and the novel {n}{ahead}.",
        "count_ahead": ", {lead} ahead of the manhwa",
        "q_spoil": "Can I read the {t} novel without manhwa spoilers?",
        "a_spoil": "Yes: start from the novel chapter that matches where you left the manhwa. What the novel gets ahead on is "
                   "what the manhwa has not drawn yet, not what you already read.",
        "q_done": "Is {t} completed?",
        "a_done": "Yes, {t} is completed.",
        "a_open": "No, {t} is ongoing and still gets new chapters.",
        "eq_title": "{t}: which novel chapter does the manhwa continue from? — Manhwa {m} → Novel {n}",
        "eq_heading": "Which novel chapter should I continue {t} from?",
        "eq_ahead": "The {t} manhwa is at chapter {m} and the novel at {n}: {lead} chapters of story the manhwa has not told yet.",
        "eq_level": "The {t} manhwa is at chapter {m} and the novel at {n}: the manhwa has practically caught up with the novel.",
        "eq_q_next": "Which novel chapter does the {t} manhwa continue from?",
        "eq_q_count": "How many chapters does the {t} novel have?",
        "eq_a_count": "The novel has {n} chapters indexed and the manhwa {m}.",
        "eq_q_spoil": "Does reading the {t} novel spoil the manhwa?",
        "eq_a_spoil": "Not if you start from the chapter that matches where you left the manhwa. What the manhwa skips is ahead "
                      "of you, not behind: the novel only gets you ahead on what the manhwa has not drawn yet.",
    },
}


def genre_rows() -> list[tuple[str, str, list[str]]]:
    rows = []
    for line in GENRE_TABLE.strip().splitlines():
        parts = [p.strip() for p in line.split("|")]
        aliases = [a.strip() for a in parts[2].split(",")] if len(parts) > 2 else []
        rows.append((parts[0], parts[1], aliases))
    return rows


def board_rows() -> list[tuple[str, str]]:
    return [tuple(p.strip() for p in line.split("=")) for line in BOARD_TABLE.strip().splitlines()]
