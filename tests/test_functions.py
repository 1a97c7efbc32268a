from pyspark.sql import functions as F

from tandem.functions import genres, prose, text, urls

TITLES = [
    ("Return of the Mount Hua Sect", "en"), ("Log Into The Future", "en"), ("Stop Summoning Me!", "en"),
    ("Absolute Necromancer", "en"), ("Breakers", "en"), ("A Dragonslayer's Peerless Regression", "en"),
    ("I Have a Mythical Tree", "en"), ("History of Three States", "en"),
    ("Regreso de la Secta del Monte Hua", "es"), ("Cazando automáticamente con mis clones", "es"),
    ("Ciudad del pecado", "es"), ("Bie Zai Zhaohuan Wo La!", "otro"), ("Qing Yu Nian", "otro"),
    ("Jeoldae Hoegwi", "otro"), ("Hwasan Jaerim", "otro"), ("Madojeonsaenggi", "otro"), ("화산귀환", "otro"),
    ("Cao Võ: Hạ Cánh Đến Một Vạn Năm Sau", "otro"), ("La régression parfaite", "otro"),
    ("Forjando um Império Industrial em um Mundo Mágico", "otro"), ("Die Rückkehr der Huashan-Sekte", "otro"),
    ("Juego Mortal", "es"), ("Antiguo Supremo", "es"), ("De duende a Dios Goblin", "es"),
    ("Callate dragona malvada, ya no quiero criar hijos contigo", "es"), ("Maestro Marcial", "es"),
    ("Pensé Que Tenía Fecha Límite", "es"), ("Papá paladin.", "es"), ("Nigromante Sin Límitesㅤ", "es"),
    ("Nano Machine", "en"), ("Obligado a ser Demonio Celestial", "es"), ("Espadachin a Tiempo Completo", "es"),
    ("A Not So Fairy Tale", "en"), ("Le régresseur de la famille déchue", "otro"),
    ("Make Heroine ga Oosugiru!", "otro"), ("Origin", "en"), ("Yuan Zun", "otro"), ("Taejonbirok", "otro"),
    ("Le Sens de l'épée", "otro"), ("Le Bébé Tyran", "otro"), ("Gobelin : Évolution Infinie", "otro"),
    ("Issu de sang vulgaire", "otro"), ("Hayalet Eş", "otro"), ("SAMOTNE LEVELOWANIE: KRES BOGÓW", "otro"),
    ("Upando Sozinho: Ragnarok", "otro"), ("Sobrevivendo ao Jogo como um Bárbaro", "otro"),
]


def test_normalized_names_keep_letters_of_every_script(one):
    got = one([("  Regreso de la Secta del Monte Huá! ",), ("화산귀환",), ("Ñandú—ÉLITE",), ("й ё",)], "t string",
              text.normalize_name("t"))
    assert got == ["regreso de la secta del monte hua", "화산귀환", "nandu elite", "и е"]


def test_name_keys(one):
    got = one([("El Lancero Genio Inmortal",), ("Rey Demonio",), ("La Villana Rica Novela",)], "t string",
              text.name_keys("t"))
    assert "genio inmortal lancero" in got[0] and "lancero genio inmortal" in got[0]
    assert got[1] == ["rey demonio"]
    assert got[2][0] == "la villana rica novela" and "villana rica" in got[2]


def test_content_words(one):
    got = one([("The Gangster Baby of the Duke's Family (Promo)",), ("Los cinco reyes",)], "t string",
              text.content_words("t"))
    assert got == [["gangster", "baby", "duke", "family"], ["cinco", "rey"]]


def test_chapter_numbers(one):
    cases = [("Chapter 1938", 1938), ("Special Spinoff. Chapter 57 (Hiatus)", 57), ("Capítulo 12 – El regreso", 12),
             ("Ch. 7", 7), ("Capítulo 517.5", 517), ("https://sitio.com/obra-capitulo-45/", 45), ("Prólogo", None),
             (None, None), ("CAPÍTULO 9", 9), ("x 123456", None)]
    assert one([(c,) for c, _ in cases], "t string", text.chapter_number("t")) == [n for _, n in cases]


def test_slugs(one):
    got = one([("Regreso de la Secta del Monte Huá!",), ("  ¿Y si...?  ",), ("a" * 90,)], "t string", text.slugify("t"))
    assert got == ["regreso-de-la-secta-del-monte-hua", "y-si", "a" * 80]


def test_title_rest(one):
    cases = [("Capítulo 1200", 1200.0, ""), ("Chapter 1200", 1200.0, ""), ("Cap. 1200", 1200.0, ""),
             ("CH.1200", 1200.0, ""), ("1200", 1200.0, ""), ("  Capitulo 0173  ", 173.0, ""), ("Bab 45", 45.0, ""),
             ("Chương 45", 45.0, ""), ("Capítulo 1200: El regreso", 1200.0, "El regreso"),
             ("Chapter 12 - The End", 12.0, "The End"), ("12.5 Extra", 12.5, "Extra"),
             ("Temporada 2 capítulo 5", 5.0, "Temporada 2 capítulo 5"), ("Capítulo 99", 100.0, "Capítulo 99"),
             ("Especial de Año Nuevo", None, "Especial de Año Nuevo"), ("", 5.0, "")]
    got = one([(t, n) for t, n, _ in cases], "t string, n double", text.title_rest("t", "n"))
    assert got == [r for _, _, r in cases]


def test_trailing_marks_and_invisible_letters(one):
    assert one([("Monte Hua Novela",), ("Obra (Manhwa) Español",)], "t string", text.trim_type_marks("t")) == [
        "Monte Hua", "Obra"]
    assert one([("　Iniciando  sesión",), ("Nigromante Sin Límitesㅤ",)], "t string",
               text.clean_title("t")) == ["Iniciando sesión", "Nigromante Sin Límites"]


def test_text_hash_matches_a_plain_loop(one):
    def expected(s):
        h = 0x811C9DC5
        units = s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        digits = ""
        while True:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
            if not h:
                return digits

    samples = ["", "a", "Capítulo", "화산귀환", "😀 x", "line\n\nline" * 50]
    assert one([(s,) for s in samples], "t string", text.text_hash("t")) == [expected(s) for s in samples]


def test_sentences_thousands_ellipsis(one):
    assert one([("Uno. Dos?  Tres… cuatro",), ("",), (" sin fin ",)], "t string", text.sentences("t")) == [
        ["Uno.", "Dos?", "Tres…", "cuatro"], [""], ["sin fin"]]
    assert one([(999,), (1234,), (12345,), (1234567,)], "n int", text.thousands("n")) == [
        "999", "1234", "12.345", "1.234.567"]
    assert one([("abcdef",), ("abc",)], "t string", text.ellipsis(F.col("t"), 4)) == ["abc…", "abc"]


def test_genres(one):
    labels = "g array<string>"
    assert one([(["Action", "action", "Martial Arts", "martial_arts", "Artes marciales", "Sci-fi", "Regresión"],)],
               labels, genres.genres_in(F.col("g"))) == [["Acción", "Artes marciales", "Ciencia ficción", "Regresión"]]
    assert one([(["Acción", "Slice of Life"],)], labels, genres.genres_in(F.col("g"), "en")) == [
        ["Action", "Slice of Life"]]
    assert one([("Crazy MC",), ("Cultivo raro",)], "c string", genres.canonical_genre(F.col("c"))) == [
        "Protagonista loco", "Cultivo raro"]
    assert one([("action",), ("martial-arts",), ("slice-of-life",), ("sci-fi",), ("accion",), ("no-existe",)],
               "c string", genres.legacy_slug_target(F.col("c"))) == [
        "accion", "artes-marciales", "recuentos-de-la-vida", "ciencia-ficcion", None, None]
    assert one([(["Acción", " Fantasía "], ["Action", None, "", "Isekai"])], "a array<string>, b array<string>",
               genres.merge_genres([F.col("a"), F.col("b")])) == [["Acción", "Fantasía", "Isekai"]]


def test_adult_and_blocked(one):
    rows = [("Ella Me Enseña Mucho - Uncensored", []), ("El taller de sonidos eróticos", []),
            ("X", ["Romance", "Hentai"]), ("Heroica", ["Ecchi", "Mature"]), ("Theoretical Physics", []),
            ("X", ["Adulto"]), ("X", ["lolicon"])]
    got = one(rows, "t string, g array<string>", genres.is_adult(F.col("t"), F.col("g")))
    assert got == [True, True, True, False, False, True, True]
    assert one([(["lolicon"],), (["adult"],)], "g array<string>", genres.is_blocked(F.col("g"))) == [True, False]


def test_demography(one):
    rows = [(["Action", "Shounen"],), (["shonen"],), (["Shounen Ai"],), (["Acción", "Fantasía"],), (["Martial Arts"],),
            (["Romance"],), (["Romance", "Smut"],), (["Cocina"],)]
    assert one(rows[:3], "g array<string>", genres.stated_demography(F.col("g"))) == ["Shounen", "Shounen", None]
    assert one(rows[3:], "g array<string>", genres.demography(F.col("g"))) == [
        "Shounen", "Shounen", "Shoujo", "Seinen", None]


def test_title_language(one):
    got = one([(t,) for t, _ in TITLES], "t string", prose.title_language("t"))
    assert [(t, g) for (t, _), g in zip(TITLES, got)] == TITLES


def test_title_choice(one):
    rows = [
        ("¡Por favor, dejen de convocarme!", ["Bie Zai Zhaohuan Wo La!", "Stop Summoning Me!", "别再召唤我啦！"]),
        ("A Knight who Eternally Regresses",
         ["오늘만 사는 기사", "The Knight who Only Lives for Today", "Caballero en eterna regresión"]),
        ("Amigo de la Infancia del Zenith",
         ["Amigo De La Infancia Del Zenith Novela", "Shadow of the Supreme", "천하제일인의 소꿉친구"]),
        ("Breakers", ["브레이커즈"]),
    ]
    schema = "t string, a array<string>"
    assert one(rows, schema, prose.title_in(F.col("t"), F.col("a"), "en")) == [
        "Stop Summoning Me!", "A Knight who Eternally Regresses", "Shadow of the Supreme", "Breakers"]
    assert one(rows, schema, prose.second_name(F.col("t"), F.col("a"), "es")) == [
        "Stop Summoning Me!", "Caballero en eterna regresión", "Shadow of the Supreme", None]


def test_prose_language(one):
    rows = [("After dying at the hands of his master, the young swordsman returns to the day he joined the sect and "
             "swears to change his fate with the knowledge of his past life.",),
            ("Después de morir a manos de su maestro, el joven espadachín regresa al día en que entró a la secta y "
             "jura cambiar su destino con lo que sabe de su vida pasada.",), ("The return of the hero",)]
    assert one(rows, "t string", prose.is_english_text("t")) == [True, False, False]
    assert one(rows, "t string", prose.source_language("t")) == ["en", "es", "en"]


def test_synopsis(one):
    cases = [
        ("A knight dies and wakes up again. How far can he go?\n*(Source: WEBTOON)*\n\n**Original Novel:**\n"
         "[Naver Series](https://series.naver.com/x)\n\n**Official Translations:**\n[English](https://www.webtoons.com/en/x)",
         "A knight dies and wakes up again. How far can he go?"),
        ("He gets a second chance! (From [LINE Webtoon](https://www.mangaupdates.com/groups.html?id=1))\n\n"
         "**Original Webtoon:**\n[Naver](https://comic.naver.com/x)", "He gets a second chance!"),
        ("First paragraph.\nStill the story.\n\nSecond paragraph.\n\n(Source: Tapas, edited)",
         "First paragraph.\nStill the story.\n\nSecond paragraph."),
        ("Note: previously titled X.\n\nThe real story starts here.\n\n---\n**Links:**\n- [Raw](https://x)",
         "The real story starts here."),
        ("He wakes up 23 years earlier.\n\n*Source: Line Webtoon*", "He wakes up 23 years earlier."),
        ("She must rise.\n*Source: Ink Pop*", "She must rise."),
        ("Un chico descubre un poder oculto.", "Un chico descubre un poder oculto."), (None, ""),
    ]
    assert one([(c,) for c, _ in cases], "t string", prose.clean_synopsis("t")) == [e for _, e in cases]


def test_long_unclosed_bracket_does_not_overflow(one):
    body = "(source: " + "x y " * 50_000
    assert one([(body,)], "t string", F.length(prose.clean_synopsis("t")))[0] >= 0


def test_status_and_html(one):
    assert one([("COMPLETED",), ("Releasing",), ("cancelled",), (None,)], "s string", prose.status_of("s")) == [
        "Finalizado", "En emisión", None, None]
    assert one([("<p>Uno<br/>dos &amp; tres</p><p>x&#039;y</p>",)], "s string", text.strip_html("s")) == [
        "Uno\ndos & tres\n\nx'y"]


def test_urls(one):
    rows = [("https://www.Site.com:80/a?b",), ("no-es-una-url",), (None,), ("http://m.x.org/#z",)]
    assert one(rows, "u string", urls.host_of("u")) == ["site.com", "", "", "m.x.org"]
    assert one([("https://x.test/en/novela/Mi%20Obra/capitulo-1",), ("/novela/a-b",), ("mi-obra",), ("https://x/y/z",)],
               "u string", urls.slug_in_url("u")) == ["mi obra", "a-b", "mi-obra", None]
