"""Sets, patterns and ordered rules that results depend on, stated as they are."""

# --- file kinds -------------------------------------------------------------------------------
# Results depend on each of these and on its order.
ARCHIVE_EXTENSIONS = [
    ".zip", ".7z", ".rar", ".tar", ".gz", ".bz2", ".xz", ".tgz", ".tbz", ".tbz2", ".txz", ".cbz", ".cbr", ".iso",
]
BOOK_EXTENSIONS = [
    ".epub", ".fb2", ".pdf", ".djvu", ".mobi", ".pdb", ".azw", ".azw3", ".lit", ".lrf", ".prc", ".rtf", ".txt",
    ".doc", ".docx", ".odt", ".chm", ".html", ".htm", ".md", ".ppt", ".pptx", ".xls", ".xlsx", ".csv", ".xps",
    ".oxps",
]
BOOK_FILETYPE_MIMES = [
    "application/pdf", "application/epub+zip", "application/x-mobipocket-ebook", "application/vnd.ms-htmlhelp",
    "application/msword", "application/rtf", "text/rtf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.oasis.opendocument.text",
    "application/vnd.ms-xpsdocument", "application/oxps", "application/postscript",
]
BOOK_FILETYPE_EXTENSIONS = [
    "pdf", "epub", "mobi", "azw", "azw3", "doc", "docx", "rtf", "odt", "chm", "xps", "oxps",
]
BOOK_ZIP_CONTAINER_EXTENSIONS = [
    ".epub", ".docx", ".pptx", ".xlsx", ".odt", ".xps", ".oxps",
]
ARCHIVE_FILETYPE_MIMES = [
    "application/zip", "application/x-7z-compressed", "application/x-rar-compressed", "application/gzip",
    "application/x-gzip", "application/x-bzip2", "application/x-xz", "application/x-tar",
]
ARCHIVE_KINDS = [
    "zip", "7z", "rar", "gz", "bz2", "xz", "tar",
]
STRONG_NONBOOK_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".svg", ".ico", ".cur", ".mp3", ".wav",
    ".flac", ".ogg", ".aac", ".m4a", ".wma", ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".exe", ".msi", ".dll",
    ".sys", ".bin", ".iso", ".ttf", ".otf", ".woff", ".woff2", ".psd", ".ai", ".db", ".sqlite", ".sqlite3", ".swf",
    ".js", ".css", ".ini", ".cfg", ".conf", ".inf", ".log", ".tmp", ".bak", ".old", ".dat", ".hex", ".cod", ".pjt",
    ".maa", ".mos", ".rom", ".nes", ".sfc", ".smc", ".gb", ".gbc", ".gba", ".sav", ".com", ".bat", ".cmd", ".vbs",
    ".ps1", ".obj", ".lib", ".o", ".class", ".jar", ".apk", ".cab", ".fbd",
]
TINY_UNKNOWN_BINARY_BYTES = 65536
TEXT_EXTENSIONS = [
    ".txt", ".md", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".fb2", ".rtf",
]
BOOK_CONTENT_TOKENS = [
    "isbn", "глава", "автор", "пролог", "эпилог", "оглавление", "предисловие", "посвящени", "издательств",
    "правообладател", "chapter", "prologue", "epilogue", "foreword", "preface", "all rights reserved",
    "published by", "©",
]
#: (label, hex of the first bytes), in order.
BOOK_MAGIC = (("xml_utf8bom", "EFBBBF3C3F786D6C"), ("xml", "3C3F786D6C"), ("pdf", "25504446"), ("ole_doc", "D0CF11E0A1B11AE1"))
ARCHIVE_MAGIC = ("504B0304", "526172211A07", "377ABCAF271C")

# --- text -------------------------------------------------------------------------------------
# Results depend on each of these and on its order.
INVALID_FS_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
PORTAL_ID = r"\.\d{5,}$"
TRAILING_ID = r"[\s._\-]+\d{5,}\s*$"
SKIP_VALUES = [
    "", "unknown", "unknown title", "unknown author", "untitled", "title", "author", "n/a", "none", "...", "книга",
    "автор", "неизвестно", "неизвестный", "не определено", "неизвестен", "нет данных",
]
UNKNOWN_TITLES = ("unknown", "unknown title")
UNKNOWN_AUTHORS = ("unknown", "unknown author")
FILENAME_PATTERNS = (
    ("author", r"^\s*(.+?)\s*[-–—]\s*(.+?)\s*$"),
    ("title", r"^\s*(.+?)\s*\((.+?)\)\s*$"),
    ("author", r"^\s*([А-Яа-яA-Za-z\s,]{3,50})\s*\.\s+(.+?)\s*$"),
    ("author", r"^\s*([А-Яа-яA-Za-z]\.\s*(?:[А-Яа-яA-Za-z]\.\s*)?[А-Яа-яA-Za-z\s,]{3,50})\s*\.\s+(.+?)\s*$"),
)
ISBN_PATTERNS = (
    r"(?i)\bISBN(?:-1[03])?\s*[:：]?\s*([0-9Xx][0-9Xx\-\s]{8,20}[0-9Xx])",
    r"\b(97[89][0-9\-\s]{10,20}[0-9])\b",
    r"\b([0-9][0-9\-\s]{8,16}[0-9Xx])\b",
)

# --- genres -----------------------------------------------------------------------------------
# Results depend on each of these and on its order.
#: Canonical genre and its English name, in order.
GENRES = {
    "Фантастика": "Science Fiction",
    "Фэнтези": "Fantasy",
    "Детективы и триллеры": "Mystery and Thrillers",
    "Романы": "Romance",
    "Детская литература": "Children's Literature",
    "Поэзия": "Poetry",
    "Художественная литература": "Fiction",
    "История": "History",
    "Военное дело": "Military",
    "Политика и право": "Politics and Law",
    "Экономика и бизнес": "Business and Economics",
    "Наука": "Science",
    "Техника": "Engineering and Technology",
    "Программирование и IT": "Programming and IT",
    "Медицина и здоровье": "Medicine and Health",
    "Биология и природа": "Biology and Nature",
    "Сельское хозяйство и садоводство": "Agriculture and Gardening",
    "Дом, хобби и ремесла": "Home, Hobbies and Crafts",
    "Кулинария": "Cooking",
    "Искусство и дизайн": "Art and Design",
    "Религия и философия": "Religion and Philosophy",
    "Психология и саморазвитие": "Psychology and Self-Development",
    "Языкознание": "Language and Linguistics",
    "Образование": "Education",
    "Справочники и энциклопедии": "References and Encyclopedias",
    "Путешествия и география": "Travel and Geography",
    "Спорт": "Sports",
    "Документальная литература": "Nonfiction",
    "Unknown": "Unknown",
}
GENRE_PLACEHOLDERS = ("unknown", "unknown genre", "none", "null", "n/a", "na", "-", "_")
GENRE_NOISE = (
    r"(?i)(https?://|www\.|isbn|issn|doi|copyright|all rights reserved|издательств|перепечатка|front matter|subject|"
    r"untitled|new subject|series|серия|guide to custom|handbook chemical process)"
)
#: Ordered rules: the first genre with a key inside the text wins.
GENRE_RULES = (
    ("Справочники и энциклопедии", ("энциклоп", "encyclop", "справоч", "reference", "dictionary", "словар")),
    ("Программирование и IT", (
        "programming", "software", "computer science", "network", "firewall", "embedded", "algorithm",
        "information theory", "алгоритм", "программ", "компьютер", "it_",
    )),
    ("Фантастика", ("science fiction", "sci-fi", "sf_", "sf ", "фантаст", "dystopian", "space opera")),
    ("Фэнтези", ("fantasy", "фэнтез", "магич", "magical realism")),
    ("Детективы и триллеры", ("detective", "mystery", "crime", "thriller", "детектив", "криминал")),
    ("Романы", ("romance", "love_", "romantic", "роман", "erotica")),
    ("Детская литература", ("children", "child_", "young adult", "сказк", "детск")),
    ("Поэзия", ("poetry", "verse", "поэз", "стих")),
    ("История", ("history", "истор", "археолог", "ancient history")),
    ("Военное дело", (
        "military", "war ", "weapons", "firearms", "ballistics", "survival", "tactics", "военн", "оруж", "снайпер",
        "самообор",
    )),
    ("Политика и право", ("politic", "law", "legal", "juris", "право", "юрис", "полит", "закон")),
    ("Экономика и бизнес", ("econom", "business", "finance", "management", "маркет", "бизнес", "эконом", "финанс")),
    ("Медицина и здоровье", (
        "medicine", "medical", "health", "fitness", "dentistry", "yoga", "медицин", "здоров", "психотерап",
    )),
    ("Биология и природа", (
        "biology", "botany", "zoology", "nature", "natural history", "paleontology", "anthropology", "биолог",
        "ботан", "зоолог", "природ",
    )),
    ("Сельское хозяйство и садоводство", (
        "agriculture", "gardening", "garden", "home_garden", "veterinary", "pet care", "садов", "огород", "сельск",
        "пчелов", "животновод", "ветерин",
    )),
    ("Кулинария", ("culinary", "cooking", "cook", "кулинар", "рецепт", "винодел", "напит")),
    ("Дом, хобби и ремесла", (
        "diy", "craft", "hobby", "home_", "home decor", "interior", "origami", "рукодел", "хобби", "ремес", "дом",
        "мебел", "быт",
    )),
    ("Искусство и дизайн", (
        "art", "design", "architecture", "photography", "music", "искусств", "дизайн", "архитект", "музык",
        "фотограф",
    )),
    ("Религия и философия", (
        "religion", "theology", "christian", "bible", "buddhism", "islam", "judaism", "orthodox", "philosophy",
        "esoteric", "религ", "православ", "философ", "мифолог", "эзотер",
    )),
    ("Психология и саморазвитие", (
        "psychology", "self-help", "self help", "parenting", "саморазвит", "самосоверш", "психолог",
    )),
    ("Языкознание", ("language", "linguistics", "esperanto", "grammar", "язык", "лингв", "граммат")),
    ("Образование", ("education", "textbook", "text books", "учеб", "образован", "пособ")),
    ("Путешествия и география", ("travel", "geography", "geology", "географ", "геолог", "путевод")),
    ("Спорт", ("sport", "спорт", "хоккей")),
    ("Техника", (
        "engineering", "technical", "technology", "manual", "automotive", "construction", "chemistry", "physics",
        "astronomy", "math", "mathematics", "электрон", "техник", "строитель", "хим", "физик", "математ", "автомоб",
    )),
    ("Наука", ("science", "наука", "науч", "academic journal")),
    ("Документальная литература", (
        "nonfiction", "non-fiction", "memoir", "biography", "publicism", "document", "документ", "публицист",
        "биограф", "мемуар", "критика",
    )),
    ("Художественная литература", (
        "fiction", "literature", "novel", "short stories", "prose", "comedy", "humor", "adventure", "action",
        "folk", "folklore", "литератур", "проза", "юмор", "приключ",
    )),
)
#: Ordered keywords inside a lower-case path.
PATH_GENRES = (
    ("Фантастика", ("science fiction", "sci-fi", "scifi", "фантастик")),
    ("Фэнтези", ("фэнтез", "fantasy")),
    ("Детективы и триллеры", ("детектив", "триллер", "thriller", "криминал", "mystery")),
    ("Поэзия", ("поэзи", "поэз", "стихи", "poetry")),
    ("Детская литература", ("детск", "сказк", "children")),
    ("Романы", ("romance", "роман")),
    ("Документальная литература", ("non-fiction", "nonfiction", "документальн", "биограф", "мемуар")),
    ("Образование", ("образован", "учеб")),
    ("Справочники и энциклопедии", ("энциклопед", "справоч", "словар")),
    ("Художественная литература", ("художественн", "fiction", "проза", "литератур")),
    ("История", ("истор", "history")),
    ("Военное дело", ("военн", "military", "оруж")),
    ("Политика и право", ("полит", "юрид", "law")),
    ("Экономика и бизнес", ("эконом", "бизнес", "финанс", "business")),
    ("Программирование и IT", ("программ", "компьютер", "programming")),
    ("Наука", ("наук", "science")),
    ("Техника", ("техник", "engineering", "technology")),
    ("Медицина и здоровье", ("медицин", "здоров", "health", "medicine")),
    ("Биология и природа", ("биолог", "природ", "biology")),
    ("Сельское хозяйство и садоводство", ("сельск", "садов", "огород")),
    ("Кулинария", ("кулинар", "рецепт", "cooking")),
    ("Дом, хобби и ремесла", ("хобби", "ремесл")),
    ("Искусство и дизайн", ("искусств", "дизайн")),
    ("Религия и философия", ("религи", "философ", "religion")),
    ("Психология и саморазвитие", ("психолог", "саморазвит", "psychology")),
    ("Языкознание", ("языкознан", "лингв", "linguistics")),
    ("Путешествия и география", ("путешест", "географ", "travel")),
    ("Спорт", ("спорт", "sport")),
)

# Published signatures of file kinds, as (first byte, hexadecimal bytes, extension, MIME type).
KIND_SIGNATURES = (
    (0, "25504446", "pdf", "application/pdf"),
    (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970", "epub", "application/epub+zip"),
    (60, "424F4F4B4D4F4249", "mobi", "application/x-mobipocket-ebook"),
    (0, "7B5C727466", "rtf", "application/rtf"),
    (0, "504B0304", "zip", "application/zip"),
    (0, "504B0506", "zip", "application/zip"),
    (0, "526172211A07", "rar", "application/x-rar-compressed"),
    (0, "377ABCAF271C", "7z", "application/x-7z-compressed"),
    (0, "1F8B08", "gz", "application/gzip"),
    (0, "425A68", "bz2", "application/x-bzip2"),
    (0, "FD377A585A00", "xz", "application/x-xz"),
    (257, "7573746172", "tar", "application/x-tar"),
    (0, "89504E470D0A1A0A", "png", "image/png"),
    (0, "FFD8FF", "jpg", "image/jpeg"),
    (0, "474946383761", "gif", "image/gif"),
    (0, "474946383961", "gif", "image/gif"),
    (8, "57454250", "webp", "image/webp"),
    (0, "49492A00", "tif", "image/tiff"),
    (0, "4D4D002A", "tif", "image/tiff"),
    (0, "494433", "mp3", "audio/mpeg"),
    (0, "664C6143", "flac", "audio/x-flac"),
    (0, "4F676753", "ogg", "audio/ogg"),
    (8, "57415645", "wav", "audio/x-wav"),
    (8, "41564920", "avi", "video/x-msvideo"),
    (4, "66747970", "mp4", "video/mp4"),
    (0, "1A45DFA3", "mkv", "video/x-matroska"),
    (0, "7F454C46", "elf", "application/x-executable"),
    (0, "53514C69746520666F726D6174203300", "sqlite", "application/x-sqlite3"),
    (0, "774F4646", "woff", "application/font-woff"),
    (0, "774F4632", "woff2", "application/font-woff"),
)
