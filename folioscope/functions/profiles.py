"""Language profiles. All tables here are fixed values: results depend on these very entries."""

# Stop words.
STOP_EN = """
a about above after again against all am an and any are as at be because been before being below between both but
by can could did do does doing down during each few for from further had has have having he her here hers herself
him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
there these they this those through to too under until up very was we were what when where which while who whom why
will with would you your yours yourself yourselves also may might must shall however thus
""".split()
STOP_UZ = """
va bilan uchun bu u ham esa lekin ammo biroq yoki bo'lib bo'ladi bo'lgan hisoblanadi kabi deb edi emas har bir
shu ushbu mazkur o'z bo'yicha orqali sababli tomonidan qilib qilish keyin oldin hamda ya'ni agar chunki ko'ra yana
juda eng barcha ular biz men siz nima qanday qaysi hech hamma o'sha shunday bunday endi faqat balki ekan ekanligi
bor yo'q kerak lozim mumkin etib etadi etilgan qiladi qilingan uning ularning bizning bunda unda shuning ichida
ning ga da dan ni dir hali doim yil yilda
""".split()
STOP_RU = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня
еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там
потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе
под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были
куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая
много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно
всю между это является также которые который которая которое данный данной данного является являются
""".split()
STOP = {"uz": STOP_UZ, "ru": STOP_RU, "en": STOP_EN}
SCRIPT = {"uz": "latin", "ru": "cyrillic", "en": "latin"}

# Letters that look alike, and the transliteration to Latin.
INVISIBLE = "​‌‍‎‏⁠⁡⁢⁣⁤﻿­᠎"
APOSTROPHES = "ʻʼ’‘`´ʹ′"
CYR_LOOK = "аеорсухкмтвніјѕһАВЕКМНОРСТХУІЈЅ"
LAT_LOOK = "aeopcyxkmtbhijshABEKMHOPCTXYIJS"
LAT_BACK = "aeopcyxkmtbhABEKMHOPCTXY"
CYR_BACK = "аеорсухкмтвнАВЕКМНОРСТХУ"
TRANSLIT_ONE = ("абвгджзийклмнопрстуфхъыэқҳ", "abvgdjziyklmnoprstufx'ieqh")
TRANSLIT_MANY = (("ё", "yo"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sh"), ("ю", "yu"), ("я", "ya"), ("ў", "o'"), ("ғ", "g'"), ("ь", ""))

# English discourse markers, formulas, qualifiers, endings, academic words.
TRANSITIONS_EN = [
    "moreover", "furthermore", "additionally", "in addition", "however", "therefore", "thus", "consequently", "overall", "in conclusion", "ultimately", "notably", "importantly", "firstly",
    "secondly", "thirdly", "finally", "as a result", "on the other hand", "in contrast", "similarly", "likewise", "nevertheless", "hence", "in summary", "to summarize", "to sum up", "in essence",
    "equally important", "by contrast",
]
GENERIC_EN = [
    "it is important to note", "it is worth noting", "it should be noted", "plays a crucial role", "plays a vital role", "plays a pivotal role", "plays a key role", "plays an important role",
    "in today's rapidly", "in today's world", "rapidly evolving", "ever-evolving", "a wide range of", "delve into", "delves into", "shed light on", "sheds light on", "navigate the complexities",
    "the complexities of", "multifaceted", "a comprehensive understanding", "comprehensive analysis", "holistic approach", "paving the way", "pave the way", "a testament to", "in the realm of",
    "underscores the importance", "highlights the importance", "valuable insights", "in conclusion", "tapestry", "the landscape of", "seamlessly", "harness the power", "unlock the potential",
    "cutting-edge", "robust framework", "it is essential to", "a significant impact on", "various aspects", "a crucial aspect", "serves as a", "in the context of today's", "fostering", "ensuring that",
    "offers a nuanced", "nuanced understanding", "key takeaway", "stands as a",
]
QUALIFIERS_EN = [
    "various", "numerous", "crucial", "vital", "essential", "pivotal", "comprehensive", "innovative", "robust", "seamless", "profound", "dynamic", "diverse", "significant", "key", "transformative",
    "invaluable", "holistic", "nuanced",
]
FORMAL_EN = "(tion|tions|ment|ments|ity|ities|ness|ance|ence|ization|isation)$"
ACADEMIC_EN = "analysis approach assess concept data method research significant theory hypothesis variable framework evidence empirical methodology context factor structure process indicate interpret establish derive estimate correlation sample statistical".split()

# Middle, scale, direction and weight of each style signal.
BASELINES = {
    "sentence_length_cv": (0.42, 0.08, -1, 1.4), "generic_phrase_density": (0.9, 0.45, 1, 1.6), "transition_start_ratio": (0.22, 0.08, 1, 1.1), "opening_repetition": (0.30, 0.12, 1, 0.6),
    "template_repetition": (0.16, 0.07, 1, 0.8), "specificity_density": (3.2, 1.3, -1, 1.3), "lexical_uniformity": (0.045, 0.02, -1, 0.5), "triad_density": (0.22, 0.12, 1, 0.5),
    "formalization_density": (9.0, 3.0, 1, 0.4), "paragraph_uniformity": (0.35, 0.12, -1, 0.5), "qualifier_density": (2.0, 0.9, 1, 0.7),
}

# Patterns.
WORD = "[\\p{L}\\p{Nl}\\p{No}]+(?:'[\\p{L}\\p{Nl}\\p{No}]+)*"
SENTENCE_END = "([.!?…]+[\"'»”)\\]]*)\\s+([\"'«“(\\[]?[A-ZА-ЯЁЎҚҒҲ0-9])"
NUMBER = "[0-9]+(?:[.,][0-9]+)?%?"
NUMERIC_CITATION = "\\[\\s*[0-9]+(?:\\s*[,;–-]\\s*[0-9]+)*\\s*\\]"
YEAR = "(?:19|20)[0-9][0-9]"
HEADING_WORDS = "^([0-9ivx]+[.)]? +)?(abstract|summary|introduction|methods|methodology|results|discussion|conclusions?|references|bibliography|works cited|appendix|введение|заключение|выводы|аннотация|приложение|список литературы|список использованной литературы|литература|kirish|xulosa|annotatsiya|ilova|foydalanilgan adabiyotlar|foydalanilgan adabiyotlar ro'yxati|adabiyotlar)[.:]?$"
REFERENCES_HEADING = "^([0-9ivx]+[.)]? +)?(references|bibliography|works cited|список литературы|список использованной литературы|литература|foydalanilgan adabiyotlar|foydalanilgan adabiyotlar ro'yxati|adabiyotlar)[.:]?$"
# up to 1500 characters, in two steps: one engine repeats no more than 1000 times
QUOTE = "«[^«»]{12,1000}[^«»]{0,500}»|“[^“”]{12,1000}[^“”]{0,500}”|„[^„“”]{12,1000}[^„“”]{0,500}[“”]|\"[^\"]{12,1000}[^\"]{0,500}\""
CITED_AFTER = "\\s*[,.;:]?\\s*(?:\\[\\s*[0-9]+[^\\]]{0,30}\\]|\\([^()]{0,80}?(?:19|20)[0-9]{2}[a-z]?[^()]{0,20}\\)|\\[\\s*[A-ZА-ЯЁa-z][^\\]]{0,60}\\])"

# Stock phrases that never count as borrowed.
TEMPLATES_UZ = [
    "mavzuning dolzarbligi", "dolzarbligi shundaki", "tadqiqotning dolzarbligi", "ushbu ishda", "ushbu maqolada", "ushbu tadqiqotda", "ushbu bitiruv malakaviy ishida", "tadqiqotning maqsadi",
    "tadqiqot maqsadi", "tadqiqotning vazifalari", "tadqiqot vazifalari", "tadqiqot obyekti", "tadqiqot ob'ekti", "tadqiqot predmeti", "tadqiqotning ilmiy yangiligi",
    "ilmiy yangiligi quyidagilardan iborat", "tadqiqot natijalarining amaliy ahamiyati", "natijalarning amaliy ahamiyati", "tadqiqot natijalarining ilmiy ahamiyati", "tadqiqot metodlari",
    "tadqiqot usullari", "ishning tuzilishi va hajmi", "dissertatsiyaning tuzilishi va hajmi", "dissertatsiya kirish", "xulosa va takliflar", "foydalanilgan adabiyotlar ro'yxati",
    "shuni ta'kidlash kerakki", "shuni ta'kidlash joizki", "shuni aytish mumkinki", "yuqoridagilardan kelib chiqib", "yuqoridagilardan xulosa qilib aytganda", "xulosa qilib aytganda",
    "xulosa o'rnida shuni aytish mumkinki", "bugungi kunda", "hozirgi kunda", "so'nggi yillarda", "shu bilan birga", "bundan tashqari", "birinchi navbatda", "muhim ahamiyat kasb etadi",
    "katta ahamiyatga ega", "alohida e'tibor qaratilmoqda", "tadqiqot natijalari shuni ko'rsatdiki", "olingan natijalar shuni ko'rsatadiki", "mazkur tadqiqotda", "mazkur ishda",
    "quyidagi xulosalarga kelindi",
]
TEMPLATES_RU = [
    "актуальность темы", "актуальность темы исследования", "актуальность исследования", "в данной работе", "в настоящей работе", "в данной статье", "в настоящей статье", "цель исследования",
    "целью исследования является", "задачи исследования", "объект исследования", "предмет исследования", "научная новизна", "научная новизна исследования", "практическая значимость",
    "теоретическая значимость", "методы исследования", "структура и объем работы", "структура работы", "список использованной литературы", "следует отметить что", "необходимо отметить что",
    "таким образом можно сделать вывод", "таким образом", "в заключение", "в настоящее время", "в последние годы", "на сегодняшний день", "кроме того", "вместе с тем", "в первую очередь",
    "имеет большое значение", "играет важную роль", "результаты исследования показали", "полученные результаты показывают", "можно сделать следующие выводы",
]
TEMPLATES_EN = [
    "the aim of this study", "the purpose of this study", "the aim of the research", "in this paper", "in this article", "in this study", "in this work", "the relevance of the topic",
    "research objectives", "the objectives of the study", "object of the research", "subject of the research", "scientific novelty", "practical significance", "theoretical significance",
    "research methods", "structure of the thesis", "list of references", "it should be noted that", "it is worth noting that", "in conclusion", "to sum up", "in recent years", "at the same time",
    "first of all", "plays an important role", "is of great importance", "the results of the study showed", "the results show that", "the following conclusions",
]

# The same lists for Uzbek and Russian.
TRANSITIONS_UZ = [
    "shuningdek", "bundan tashqari", "shu bilan birga", "biroq", "ammo", "lekin", "demak", "xulosa qilib aytganda", "natijada", "birinchidan", "ikkinchidan", "uchinchidan", "avvalo", "jumladan",
    "aksincha", "shunday qilib", "qolaversa", "ta'kidlash joizki", "shu sababli", "shuning uchun", "umuman olganda", "binobarin", "yakuniy", "yakunda", "eng muhimi", "shu nuqtai nazardan",
    "boshqacha aytganda", "o'z navbatida", "qo'shimcha ravishda",
]
GENERIC_UZ = [
    "muhim ahamiyat kasb etadi", "muhim ahamiyatga ega", "alohida ahamiyatga ega", "katta ahamiyatga ega", "muhim rol o'ynaydi", "hal qiluvchi rol o'ynaydi", "muhim o'rin tutadi",
    "alohida o'rin tutadi", "shuni ta'kidlash kerakki", "shuni ta'kidlash joizki", "ta'kidlash lozimki", "ta'kidlash joizki", "zamonaviy dunyoda", "globallashuv sharoitida", "keng qamrovli",
    "kompleks yondashuv", "yangi imkoniyatlar ochib beradi", "yangi imkoniyatlar yaratadi", "samaradorligini oshirishga xizmat qiladi", "dolzarb masalalardan biri hisoblanadi",
    "muhim omil hisoblanadi", "yangi bosqichga ko'taradi", "barqaror rivojlanishini ta'minlaydi", "xulosa qilib aytganda", "salmoqli hissa qo'shadi", "keng ko'lamli",
    "ajralmas qismi hisoblanadi", "innovatsion yondashuv", "muhim vazifalardan biri", "tizimli yondashuv", "chuqur tahlil qilish", "muhim ahamiyatga ega ekanligini", "yaxlit yondashuv",
    "ko'p qirrali", "samarali vosita hisoblanadi", "asosiy omillardan biri",
]
QUALIFIERS_UZ = ["samarali", "innovatsion", "keng qamrov", "muhim", "dolzarb", "zamonaviy", "turli", "xilma-xil", "kompleks", "tizimli", "yaxlit", "chuqur", "salmoqli", "strategik"]
FORMAL_UZ = "(?:lik|lash|lashtirish|ish|uv|iya|siya|tsiya|chilik|garlik)(?:lar)?(?:i|si|ning|ni|ga|da|dan|ini|ining|iga|ida|idan|imiz)?$"
ABBREVIATIONS_UZ = ["h.k.", "va b.", "b.", "y.", "yy.", "prof.", "akad.", "t.", "s.", "sh.", "m.", "rasm.", "jadv.", "bet.", "no."]
ACADEMIC_UZ = "tahlil tadqiqot usul metod nazariya gipoteza natija xulosa omil jarayon tizim tuzilma samaradorlik ko'rsatkich ma'lumot empirik konsepsiya yondashuv model baholash mezon tamoyil tajriba statistik o'zgaruvchi korrelyatsiya dalil manba ilmiy".split()
TRANSITIONS_RU = [
    "кроме того", "более того", "таким образом", "следовательно", "однако", "в то же время", "во-первых", "во-вторых", "в-третьих", "в заключение", "итак", "поэтому", "тем не менее", "в частности",
    "помимо этого", "вместе с тем", "в целом", "подводя итог", "следует отметить", "важно отметить", "стоит отметить", "необходимо подчеркнуть", "наконец", "также", "кроме этого", "в результате",
    "с другой стороны", "аналогично", "при этом",
]
GENERIC_RU = [
    "играет ключевую роль", "играет важную роль", "играет значимую роль", "имеет важное значение", "имеет огромное значение", "важно отметить", "следует отметить", "стоит отметить",
    "необходимо подчеркнуть", "в современном мире", "в условиях глобализации", "в современных условиях", "неотъемлемой частью", "комплексный подход", "многогранный", "широкий спектр",
    "открывает новые возможности", "способствует повышению", "в заключение можно сказать", "подводя итог", "можно сделать вывод", "всесторонний анализ", "ключевым фактором",
    "не вызывает сомнений", "является одним из важнейших", "в эпоху цифровизации", "целостный подход", "синергетический эффект", "играет решающую роль", "служит основой",
    "позволяет глубже понять", "представляет собой важный",
]
QUALIFIERS_RU = ["различн", "многочисленн", "важнейш", "ключев", "значительн", "эффективн", "инновационн", "комплексн", "всесторонн", "современн", "актуальн", "целостн", "стратегическ", "глубок"]
FORMAL_RU = "(?:ние|ния|нию|нием|нии|ость|ости|остью|ция|ции|цию|цией|ство|ства|ству|ством|стве|изм|изма)$"
ABBREVIATIONS_RU = ["т.е.", "т.д.", "т.п.", "и др.", "др.", "г.", "гг.", "см.", "рис.", "табл.", "с.", "т.", "стр.", "проф.", "акад.", "им.", "т.к.", "напр.", "в.", "вв.", "св.", "ред.", "изд.", "№"]
ACADEMIC_RU = "анализ исследован метод теори гипотез результат вывод фактор процесс систем структур эффективност показател данн эмпирическ концепц подход модел оценк критери принцип эксперимент статистическ".split()
ABBREVIATIONS_EN = ["e.g.", "i.e.", "et al.", "fig.", "eq.", "vol.", "no.", "pp.", "p.", "dr.", "mr.", "mrs.", "ms.", "vs.", "etc.", "cf.", "ed.", "eds.", "approx.", "ch.", "sec.", "tab."]
TRANSITIONS = {"uz": TRANSITIONS_UZ, "ru": TRANSITIONS_RU, "en": TRANSITIONS_EN}
GENERIC = {"uz": GENERIC_UZ, "ru": GENERIC_RU, "en": GENERIC_EN}
QUALIFIERS = {"uz": QUALIFIERS_UZ, "ru": QUALIFIERS_RU, "en": QUALIFIERS_EN}
FORMAL = {"uz": FORMAL_UZ, "ru": FORMAL_RU, "en": FORMAL_EN}
ABBREVIATIONS = {"uz": ABBREVIATIONS_UZ, "ru": ABBREVIATIONS_RU, "en": ABBREVIATIONS_EN}
ACADEMIC = {"uz": ACADEMIC_UZ, "ru": ACADEMIC_RU, "en": ACADEMIC_EN}
AND = {"uz": "va", "ru": "и", "en": "and"}
LONG_SENTENCE = {"uz": 35, "ru": 38, "en": 40}
MOST_CONFIDENCE = {"uz": "medium", "ru": "high", "en": "high", "unknown": "low"}
# where a language's middle and scale differ from BASELINES
BASELINES_OF = {
    "uz": {"formalization_density": (15.0, 4.0), "qualifier_density": (3.0, 1.2), "generic_phrase_density": (1.0, 0.5), "transition_start_ratio": (0.20, 0.08)},
    "ru": {"formalization_density": (11.0, 3.5), "qualifier_density": (2.2, 1.0)},
}
UZ_ENDINGS = "(o'|g'|.(lar|ning|dagi|lari|ligi|ni|ga|da|dan)$)"
CITATION = "(?i)(?:\\[\\s*[0-9]+(?:\\s*[,;–-]\\s*[0-9]+)*(?:\\s*[,;]\\s*(?:p|pp|s|b|с|стр|bet)[.]?\\s*[0-9]+(?:\\s*[–-]\\s*[0-9]+)?)?\\s*\\]|[(][^()]{0,80}?(?:19|20)[0-9]{2}[a-z]?(?:[,;:]\\s*(?:p|pp|s|с|b)[.]?\\s*[0-9]+)?[)])"

# Heading words by kind, and chapter headings, of each language.
SECTION_WORDS = {
    "uz": {
        "toc": ["mundarija"], "abstract": ["annotatsiya", "referat", "abstrakt", "dissertatsiya annotatsiyasi"], "keywords": ["kalit so'zlar", "tayanch so'zlar", "tayanch iboralar"], "introduction": ["kirish"],
        "literature_review": ["adabiyotlar tahlili", "adabiyotlar sharhi", "mavzuga oid adabiyotlar tahlili"],
        "methodology": ["tadqiqot metodologiyasi", "metodologiya", "tadqiqot metodlari", "tadqiqot usullari", "material va metodlar", "tadqiqot materiallari va usullari"],
        "results": ["natijalar", "tadqiqot natijalari", "tahlil va natijalar"], "discussion": ["muhokama", "natijalar muhokamasi"],
        "conclusion": ["xulosa", "xulosalar", "umumiy xulosalar", "xulosa va takliflar", "xulosa va tavsiyalar"],
        "references": ["foydalanilgan adabiyotlar ro'yxati", "foydalanilgan adabiyotlar", "adabiyotlar ro'yxati", "adabiyotlar", "foydalanilgan manbalar"], "appendix": ["ilova", "ilovalar"],
    },
    "ru": {
        "toc": ["содержание", "оглавление"], "abstract": ["аннотация", "реферат", "автореферат"], "keywords": ["ключевые слова"], "introduction": ["введение"], "literature_review": ["обзор литературы", "литературный обзор"],
        "methodology": ["методология", "методы исследования", "материалы и методы", "методология исследования", "методика исследования"], "results": ["результаты", "результаты исследования"],
        "discussion": ["обсуждение", "обсуждение результатов"], "conclusion": ["заключение", "выводы", "заключение и выводы"],
        "references": ["список литературы", "список использованной литературы", "библиографический список", "литература", "список использованных источников", "библиография"], "appendix": ["приложение", "приложения"],
    },
    "en": {
        "toc": ["table of contents", "contents"], "abstract": ["abstract", "summary"], "keywords": ["keywords", "key words"], "introduction": ["introduction"],
        "literature_review": ["literature review", "review of literature", "related work", "background"], "methodology": ["methodology", "methods", "materials and methods", "research methodology", "research design"],
        "results": ["results", "findings"], "discussion": ["discussion", "results and discussion"], "conclusion": ["conclusion", "conclusions", "concluding remarks"],
        "references": ["references", "bibliography", "works cited", "literature cited"], "appendix": ["appendix", "appendices"],
    },
}
CHAPTERS = {
    "uz": ["([ivxlc]+|[0-9]+)\\s*[-–.]?\\s*bob($|[^\\p{L}])", "bob\\s+([ivxlc]+|[0-9]+)($|[^\\p{L}])", "(birinchi|ikkinchi|uchinchi|to'rtinchi|beshinchi|oltinchi)\\s+bob($|[^\\p{L}])"],
    "ru": ["глава\\s+([ivxlc]+|[0-9]+)($|[^\\p{L}])", "([ivxlc]+|[0-9]+)\\s*[-–.]?\\s*глава($|[^\\p{L}])"],
    "en": ["chapter\\s+([ivxlc]+|[0-9]+|one|two|three|four|five|six|seven)($|[^\\p{L}])"],
}
