"""Fixed values of the regional statistics domain."""

# Names, keys and orders that results must show as they are.

#: Months, for captions.
MONTHS = [
    "yanvar", "fevral", "mart", "aprel", "may", "iyun",
    "iyul", "avgust", "sentyabr", "oktyabr", "noyabr", "dekabr",
]

#: Of several kinds of period in a year the highest counts.
PERIOD_RANK = {"year": 3, "ytd": 2, "quarter": 1, "month": 0}

#: Module to (name, short name, colour, order).
MODULES = {
    "sanaat": ("Sanaat ónimi kólemi", "Sanaat", "#0ea5e9", 1),
    "awil_xojaligi": ("Awıl xojalıǵı ónimleri", "Awıl xojalıǵı", "#a3e635", 2),
    "investitsiya": ("Tiykarǵı kapitalǵa investitsiyalar", "Investitsiya", "#818cf8", 3),
    "qurilis": ("Qurılıs jumısları", "Qurılıs", "#c084fc", 4),
    "xizmetler": ("Kórsetilgen xızmetler kólemi", "Xızmetler", "#34d399", 5),
    "transport": ("Tasılǵan júkler kólemi", "Transport", "#fbbf24", 6),
    "sawda": ("Usaqlap satıw tovar aylanısı", "Sawda", "#f97316", 7),
}

#: A name or unit with one of these is a growth rate, not a volume.
GROWTH_HINTS = ["ósim", "ósiw", "o'siw", "osim", "osiw", "%"]

#: Source folder to (id, name, second name, colour, order).
CATEGORIES = {
    "01_Makroekonomika": ("makro", "Makroekonomika", "Makroiqtisodiyot", "#38bdf8", 1),
    "02_Sanaat": ("sanaat", "Sanaat", "Sanoat", "#0ea5e9", 2),
    "03_Aw_lXojal___": ("awil_xojaligi", "Awıl xojalıǵı", "Qishloq xo'jaligi", "#a3e635", 3),
    "04_Investitsiya": ("investitsiya", "Investitsiya", "Investitsiyalar", "#818cf8", 4),
    "05_S_rtq_Sawda": ("sirtqi_sawda", "Sırtqı sawda", "Tashqi savdo", "#22d3ee", 5),
    "06_X_zmetler": ("xizmetler", "Xızmetler", "Xizmatlar", "#34d399", 6),
    "07_Transport": ("transport", "Transport", "Transport", "#fbbf24", 7),
    "08_MiynetBazar": ("miynet", "Miynet bazarı", "Mehnat bozori", "#fb7185", 8),
    "09_Xaliq": ("xaliq", "Xalıq", "Aholi", "#a78bfa", 9),
    "09_Xal_q": ("xaliq", "Xalıq", "Aholi", "#a78bfa", 9),
    "10_Bilimlendiriw": ("bilimlendiriw", "Bilimlendiriw", "Ta'lim", "#e879f9", 10),
    "11_Densawl_q": ("densawliq", "Densawlıq saqlaw", "Sog'liqni saqlash", "#f43f5e", 11),
    "12_Sawda_Bahalar": ("sawda", "Sawda hám bahalar", "Savdo va narxlar", "#f97316", 12),
    "13_Isbilermenlik": ("isbilermenlik", "Isbilermenlik", "Tadbirkorlik", "#14b8a6", 13),
    "14_Madeniyat": ("madeniyat", "Mádeniyat", "Madaniyat", "#c084fc", 14),
    "15_Finanslar": ("finanslar", "Finanslar", "Moliya", "#64748b", 15),
}
DUPLICATES_FOLDER = "00_Duplikatlar"

#: Part of a lower-case indicator name, and the module it belongs to; the first found counts.
CORE_MODULES = [
    ("rayonlar boyınsha sanaat ónimi kólemi", "sanaat"),
    ("aymaqlar boyınsha awıl xojalıǵı ónimleri", "awil_xojaligi"),
    ("aymaqlar boyınsha awıl xojalıģı ónimleri", "awil_xojaligi"),
    ("tiykarǵı kapitalǵa ózlestirilgen investitsiyalar", "investitsiya"),
    ("тiykarģı kapitalǵa ózlestirilgen investitsiyalar", "investitsiya"),
    ("qurılıs jumısları", "qurilis"),
    ("aymaqlar boyınsha kórsetilgen xızmetler kólemi", "xizmetler"),
    ("avtomobil transportinda tasılǵan júkler kólemi", "transport"),
    ("usaqlap satıw tovar aylanısınıń kólemi", "sawda"),
]
LOWER_IS_BETTER = ["inflyatsiya", "jumıssız", "jumissiz", "kóship ketken"]

#: District id, name, Russian name, centre, area, population.
DISTRICTS = [
    ("amudaryo", "Ámiwdárya", "Амударья", "Mańǵıt", 2300, 200.3),
    ("beruniy", "Beruniy", "Беруни", "Beruniy", 4000, 205.1),
    ("bozatov", "Bozataw", "Бозатау", "Bozataw", 3000, 20.4),
    ("chimboy", "Shımbay", "Чимбай", "Shımbay", 3000, 120.9),
    ("ellikqala", "Ellikqala", "Элликкала", "Bostan", 4900, 155.8),
    ("karaozak", "Qaraózek", "Караузяк", "Qaraózek", 5800, 60.3),
    ("kegeyli", "Kegeyli", "Кегейли", "Kegeyli", 2200, 90.5),
    ("moynoq", "Moynaq", "Муйнак", "Moynaq", 37600, 30.2),
    ("nukus-shahri", "Nókis qalası", "город Нукус", "Nókis", 220, 335.8),
    ("nukus-tumani", "Nókis rayonı", "Нукусский район", "Aqmańǵıt", 2000, 55.7),
    ("qanlikol", "Qanlıkól", "Канлыкуль", "Qanlıkól", 900, 45.6),
    ("qongirot", "Qońırat", "Кунград", "Qońırat", 78700, 130.4),
    ("shumanay", "Shomanay", "Шуманай", "Shomanay", 800, 55.1),
    ("taxiatosh", "Taqıyatas", "Тахиаташ", "Taqıyatas", 200, 45.9),
    ("taxtakopir", "Taxtakópir", "Тахтакупыр", "Taxtakópir", 20100, 40.7),
    ("tortkol", "Tórtkúl", "Турткуль", "Tórtkúl", 7900, 220.6),
    ("xojayli", "Xojeli", "Ходжейли", "Xojeli", 1300, 165.2),
]

#: A name without marks, and the district it stands for.
DISTRICT_NAMES = {
    "amiwdarya": "amudaryo",
    "beruniy": "beruniy",
    "bozataw": "bozatov",
    "qaraozek": "karaozak",
    "kegeyli": "kegeyli",
    "qonirat": "qongirot",
    "qanlikol": "qanlikol",
    "moynaq": "moynoq",
    "nokis": "nukus-tumani",
    "taqiyatas": "taxiatosh",
    "taxtakopir": "taxtakopir",
    "tortkul": "tortkol",
    "xojeli": "xojayli",
    "shimbay": "chimboy",
    "shomanay": "shumanay",
    "ellikqala": "ellikqala",
}
CITY = "nukus-shahri"
REPUBLIC = "__republic__"
REPUBLIC_NAMES = ["qaraqalpaqstan respublikasi", "qaraqalpaqstan respublikasinda"]

#: Letters that searching takes for others once marks are gone; "" drops them.
SEARCH_LETTERS = {
    "ı": "i", "ǵ": "g", "ğ": "g", "ģ": "g", "ń": "n", "ó": "o", "ú": "u", "á": "a",
    "ә": "a", "ө": "o", "ү": "u", "ұ": "u", "қ": "q", "ғ": "g", "ң": "n", "һ": "h",
    "'": "", "’": "", "ʻ": "", "`": "",
}

#: Hints of a unit, and words that open a breakdown.
UNIT_HINTS = [
    "swm", "som", "so'm", "sum", "mln", "mlrd", "mıń", "min ", "%", "protsent",
    "adam", "birlik", "tonna", "dana", "km", "gektar", "ga)", "dollar", "kishi",
]
BREAKDOWNS = ["sonnan", "sonnan:", "sonnan :", "onnan", "shundan", "shundan:", "in the number"]
FIRST_YEAR, LAST_YEAR = 2000, 2032

MODULE_KEYWORDS = {
    "sanaat": ["sanaat", "sanoat", "zavod", "karxana", "korxona", "islep shigariw"],
    "awil_xojaligi": [
        "awil xojaligi", "awil", "qishloq", "diyxan", "dehqon", "egin", "paxta",
        "hasil", "hosil", "agro", "suwgariw", "sugorish",
    ],
    "investitsiya": ["investitsiya", "sarmaya", "sarmoya", "investor", "kapital"],
    "qurilis": ["qurilis", "qurilish", "jay", "uy-joy", "obekt", "obyekt"],
    "xizmetler": ["xizmet", "xizmatlar", "turizm", "servis"],
    "transport": ["transport", "juk", "yuk", "tasiw", "avtomobil", "jol"],
    "sawda": ["sawda", "savdo", "satiw", "tovar", "baha", "narx", "bazar"],
}
INTENT_KEYWORDS = {
    "recommend": ["usinis", "tavsiya", "taklif", "ne islew", "nima qil", "sheshim", "ilaj", "chora"],
    "weak": ["mashqala", "muammo", "maseleli", "tomen", "past", "artta", "keyin qalgan", "hawip", "kritik", "zaif"],
    "compare": ["salistir", "solishtir", "taqqosla", "reyting", "en jaqsi", "eng yaxshi", "qaysi rayon", "qaysi tuman"],
    "annual": ["jilliq", "yillik", "dinamika", "juwmaq", "hisobot", "tariyx", "osiw pati"],
}

#: Part of a macro label, and its short name; the first found counts.
MACRO_LABELS = {
    "Jalpı aymaqlıq ónim": "JAO",
    "Sanaat ónimi": "Sanaat",
    "Awıl, toğay hám balıqshilıq": "AwılXojalıǵı",
    "Tiykarǵı kapitalǵa investitsiyalar": "Investitsiya",
    "Qurılıs jumısları": "Qurılıs",
    "Eksport": "Eksport",
    "Import": "Import",
    "Xızmetler, jámi": "Xızmetler",
    "Usaqlap satıw sawda tovar": "SawdaAylanbası",
    "Saldo": "Saldo",
}
#: Part of a district's name in labour tables, and its name; the first found counts.
LABOUR_DISTRICTS = {
    "Qoraqalpog'iston Respublikasi": "QR jámi",
    "Nukus sh.": "Nukus qalası",
    "Amudaryo": "Amudarya",
    "Beruniy": "Beruniy",
    "Bo'zatov": "Bózataw",
    "Qorao'zak": "Qaraózek",
    "Kegeyli": "Kegeyli",
    "Qo'ng'irot": "Qońırat",
    "Qanliko'l": "Qanlikól",
    "Mo'ynoq": "Mójnak",
    "Nukus": "Nukus tumani",
    "Taxiatosh": "Taxiatash",
    "Taxtako'pir": "Taxtakópir",
    "To'rtko'l": "Tórtk¸l",
    "Xo'jayli": "Xojayli",
    "Chimboy": "Shımbay",
    "Shumanay": "Shumanay",
    "Ellikqal'a": "Ellikqala",
}
#: Parts of a question, and the topics they stand for, in order.
TOPIC_KEYWORDS = {
    "jao": "JAO", "jalpı aymaqlıq": "JAO", "yalpi": "JAO", "gdp": "JAO", "umumiy mahsulot": "JAO", "regional": "JAO", "iqtisodiy o'sish": "JAO",
    "sanaat": "Sanaat", "sanoat": "Sanaat", "industry": "Sanaat", "ximiya": "Sanaat", "toqımashılıq": "Sanaat", "azıq": "Sanaat",
    "awıl": "AwılXojalıǵı", "awil": "AwılXojalıǵı", "qishloq": "AwılXojalıǵı", "dıyqan": "AwılXojalıǵı", "sharwa": "AwılXojalıǵı", "balıq": "AwılXojalıǵı", "egin": "AwılXojalıǵı", "fermer": "AwılXojalıǵı",
    "investitsiya": "Investitsiya", "kapital": "Investitsiya", "qurılıs": "Qurılıs", "qurilish": "Qurılıs",
    "eksport": "Eksport", "import": "Import", "sawda": "Sawda", "saldo": "Saldo", "tashqi": "Eksport",
    "xızmet": "Xızmetler", "xizmat": "Xızmetler", "servis": "Xızmetler", "transport": "Xızmetler", "finanslıq": "Xızmetler",
    "jumıssız": "Jumıssızlıq", "ishsiz": "Jumıssızlıq", "bandlik": "Jumıssızlıq", "bántler": "Jumıssızlıq", "aktiv xalıq": "Jumıssızlıq",
    "is haqı": "IsHaqı", "maosh": "IsHaqı", "ish haqi": "IsHaqı", "aylıq": "IsHaqı",
}

#: Place on the scale and colour.
PERFORMANCE_COLOURS = [
    (0.7, (240, 113, 120)), (0.82, (208, 59, 59)), (0.9, (143, 48, 64)), (0.97, (60, 67, 99)), (1.02, (42, 95, 158)), (1.06, (42, 120, 214)), (1.15, (109, 167, 236)),
]
VOLUME_COLOURS = [(0.0, (30, 41, 74)), (0.25, (30, 78, 132)), (0.5, (26, 122, 178)), (0.75, (45, 170, 205)), (1.0, (125, 226, 231))]
NO_VOLUME, NO_GROWTH = "#1b2338", "#5a6588"
