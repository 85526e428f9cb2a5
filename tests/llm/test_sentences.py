import pytest

from tamarack.llm.sentences import language_of, sentences, split_sentences

CASES = [  # units are separated by a bar, blanks between them are free
    "The crew met Dr. Velmar at 9:30 a.m. sharp.|It left at 3 p.m.|The editor stayed.",
    "He saw J. K. Brastov at No. 254 (cf. Fig. 112) near v1.9.850.|“Is it open?” said Jadoro.",
    "It opens again... tomorrow.|“The slope waits for the results.”|(The council moved.)|It waits on a.example.invalid/p.7?x=8! in town.",
    "6. The council\n\n|The editor\nmoves.\n|The archive waits",
    "The review doesn't end etc.|The council met Oskelin Jr.|The end.",
    "The council waits (it moved! twice.) for the results.|It ends.",
    "Der Rat tagt z. B. bei Brastov gem. Nr. 188.6 in der 5. Etage usw.|Die Stadt wartet am 3. Oktober.",
    "Der Rat öffnet am 8. 8.|Das Archiv wartet (vgl. S. 685) d. h. ab 10.7.2025 früh u. a.|Das Tor ist zu.",
    "„Der Rat lehnt ab. Das Amt wartet!“ sagte Brastov.|„Der Rat wartet.“|Der Rat geht.",
    "Le conseil attend p. ex. chez M. Velmar, av. Jadoro et bd. Tunrik\xa0?|« Il bouge ? » dit J.-K. Lirbek.|«\xa0Il tient.\xa0»|Il dort etc.|La fin",
    "¿El archivo aguanta?|¡La ladera abre!|El Sr. Menquil y la Dra. Quorane miran la Avda. Lirbek según el art. 26.6 y Cía.|El consejo envía (¿otra vez? sí.) el informe.",
    "Редакция ждёт на ул. Жадоро т. е. за 599 дн. работы.|«Совет ждёт?» — сказал Тунрик.|А. К. Велмаров пришёл в 2024 г.|Архив закрыт и др.|Ночь.",
    "Το αρχείο περιμένει π.χ. στο Βέλμαρης;|Ο κ. Βέλμαρης χάνει νερό κ.λπ.|Η σύνταξη (βλ. σελ. 690) ανοίγει.",
    "档案室按v7.7版开放。|夜班组以“稳。”为由与J. K. Jadoro一起等待？！|“泵站漏水。议会等待！”奥斯林说。|“夜班组移动”。|议会……等待。",
    "議会は「水。土。」の名で待つ。|「北は残る。議会は求める！」とオスケリンは言った。\n|資料室は待つ？",
    "สภาปฏิเสธแผนกับดร. เวลมาร์ในเมืองเก่า| ห้องเอกสารรอ 627,300 บาทกับ Brastov Co. ใกล้แม่น้ำ?| สภารอ",
    "परिषद क्र. 479 पर वि. क. ओस्केलिन के साथ 7.76 मी. तक चलता है।|“परिषद खुलता है?” वेलमार ने कहा।|“रात की टोली खुलता है”।|संपादक मानता है?",
    "المجلس ينتظر مع أ. ك. أوسكلين (انظر ص. 604) نحو 16.65 م. تقريبا إلخ.|«المجلس ينتظر!» قال أوسكلين.|التحرير يرسل؟|النهر",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    text, expected, at = " ".join(case.split("|")), [], 0
    for unit in case.split("|"):
        at = text.index(unit.strip(), at)
        expected.append((at, at + len(unit.strip())))
        at = expected[-1][1]
    if any("぀" < c < "鿿" for c in case):  # without blanks
        text = case.replace("|", "")
        expected, at = [], 0
        for unit in case.split("|"):
            expected.append((at + len(unit) - len(unit.lstrip()), at + len(unit.rstrip())))
            at += len(unit)
    assert [text[a:b] for a, b in sentences(text)] == [text[a:b] for a, b in expected]
    assert sentences(text) == expected


def test_blank_texts_have_no_units():
    assert sentences(None) == sentences("") == sentences(" \n\t\n ") == []


def test_units_are_trimmed_ordered_and_cover_all_but_blanks():
    text = "  One. (Two!\n\n three)   four... “five. 'Six'\r\n\r\n7. … "
    units = sentences(text)
    assert all(a < b <= c for (a, b), (c, _) in zip(units, units[1:] + [(len(text), 0)], strict=True))
    assert "".join(text[a:b] for a, b in units).replace(" ", "") == "".join(text.split()) or all(not text[i].strip() for i in set(range(len(text))) - {i for a, b in units for i in range(a, b)})


def test_very_long_texts_take_linear_time():
    for text in ("a. " * 50_000, "“" * 100_000 + ".", "." * 200_000, "(a. B" * 20_000, "?" + " »" * 50_000):
        sentences(text)


def test_language_of_mistagged_paragraphs():
    assert [language_of(t) for t in ("The end of the day", "Das ist nicht der Rat", "Le conseil est dans la ville", "El consejo de la ciudad", "Совет", "12 34")] == ["en", "de", "fr", "es", "ru", "en"]


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b.", 5), (2, None, 5), (None, "x", 5), (3, "", 5)], "doc_id long, text string, start_char int")
    got = sorted(split_sentences(df, "doc_id", "text").collect(), key=repr)
    assert [tuple(r) for r in got] == sorted([(1, 0, 4), (1, 5, 9), (1, 0, 4), (None, 0, 1)], key=lambda r: f"Row(doc_id={r[0]}, start_char={r[1]}, end_char={r[2]})")
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_marks_alone_take_linear_time():
    for text in ("(" * 200_000 + '"' * 200_000, '"(' * 100_000, "„" * 100_000 + "“”" * 100_000, "([{«" * 50_000 + "»" * 100_000, "(“" * 100_000 + ")" * 200_000):
        assert sentences(text)


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("The crew met at the river.The editor left.", 2),
        ("Der Rat wartet seit Montag.Die Stadt auch.", 2),
        ("Redaktion von Prof.Lirbek wartet auf plan_3.v2.pdf im Tor.", 1),
        ("Il attend.L'étude bouge.", 2),
        ("ሰላም ነው። ደህና ነው፧ አዎ።", 3),  # Ethiopic
        ("ខ្ញុំទៅ។ គាត់មក។", 2),  # Khmer
        ("သူသွားသည်။ ငါလာသည်။", 2),  # Burmese
        ("Սա մեկն է։ Սա երկուսն է։", 2),  # Armenian
        ("זה משפט ראשון. זה משפט שני?", 2),  # Hebrew
        ("이것은 문장이다. 저것은 문장인가? 네.", 3),  # Korean
        ("یہ پہلا جملہ ہے۔ یہ دوسرا ہے۔", 2),  # Urdu
    ],
)
def test_glued_sentences_and_further_scripts(text, units):
    assert len(sentences(text)) == units


def test_languages_without_table():
    assert language_of("זה משפט ראשון") == language_of("이것은 문장이다") == language_of("ሰላም ነው") == "uncased"
    assert language_of("Սա մեկն է") == "other"
    assert language_of("Wszyscy ludzie rodzą wolni równi pod względem swej godności praw Są obdarzeni rozumem") == "other"
