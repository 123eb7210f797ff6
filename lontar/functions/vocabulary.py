"""Word lists of the boarding-house domain. All are defaults of parameters."""

# Short forms and slang, and what they stand for.
JARGON = {
    "kmd": "kamar mandi dalam", "km dlm": "kamar mandi dalam", "wc dlm": "kamar mandi dalam", "km dalam": "kamar mandi dalam",
    "wc dalam": "kamar mandi dalam", "km luar": "kamar mandi luar", "wc luar": "kamar mandi luar",
    "ac": "air conditioner", "tv": "televisi", "wf": "wifi",
    "jt": "juta", "rb": "ribu", "thn": "tahun", "bln": "bulan", "blnan": "bulanan", "thnan": "tahunan", "min": "minimum", "maks": "maksimum",
    "dlm": "dalam", "sblm": "sebelum", "ssdh": "sesudah", "yg": "yang", "krn": "karena", "tdk": "tidak", "gak": "tidak", "ngga": "tidak",
    "engga": "tidak", "dr": "dari", "dgn": "dengan", "utk": "untuk", "skr": "sekarang", "blm": "belum", "udh": "sudah", "udah": "sudah",
    "byk": "banyak", "sdh": "sudah", "jln": "jalan", "jl": "jalan", "rmh": "rumah", "ortu": "orang tua", "bsk": "besok", "tgl": "tanggal",
    "tgl2": "tanggal",
    "gdg meneng": "gedong meneng", "gd meneng": "gedong meneng", "rjbs": "rajabasa", "rj basa": "rajabasa", "sumbro": "sumantri brojonegoro",
    "kdtn": "kedaton", "wh": "way halim", "lab ratu": "labuhan ratu", "tj senang": "tanjung senang", "tlb": "teluk betung",
    "tjk": "tanjungkarang", "bdl": "bandar lampung", "blampung": "bandar lampung",
    "unila": "universitas lampung", "unyila": "universitas lampung", "unl": "universitas lampung",
    "fmipa": "fakultas mipa universitas lampung", "ft unila": "fakultas teknik universitas lampung",
    "fkip": "fakultas keguruan universitas lampung", "feb": "fakultas ekonomi bisnis universitas lampung",
    "uin": "uin raden intan lampung", "polnep": "politeknik negeri lampung", "itera": "institut teknologi sumatera", "kampus a": "kampus utama",
    "cowo": "putra", "cowok": "putra", "pria": "putra", "laki": "putra", "lk": "putra",
    "cewe": "putri", "cewek": "putri", "wanita": "putri", "perempuan": "putri", "pr": "putri", "mix": "campur",
    "jamal": "jam malam", "jam mlm": "jam malam", "no smoking": "dilarang merokok", "no smoke": "dilarang merokok", "free": "bebas",
    "dp": "uang muka", "uang dp": "uang muka", "down payment": "uang muka", "deposit": "uang jaminan", "all in": "termasuk semua",
    "all-in": "termasuk semua", "include": "termasuk", "exclude": "tidak termasuk",
    "kostan": "kos kosan", "kost-kostan": "kos kosan", "kost2an": "kos kosan", "kost kostan": "kos kosan", "rumah kost": "kos kosan",
    "kontrakan": "kos kosan", "kos eksekutif": "kos eksklusif", "ekslusive": "eksklusif", "exclusive": "eksklusif", "exclusif": "eksklusif",
    "exklusif": "eksklusif", "exklusive": "eksklusif", "ready": "tersedia", "available": "tersedia", "ready stock": "tersedia",
}

# Misspellings and their correction, in order.
SPELLING = {
    "fasilitsa": "fasilitas", "fasiltas": "fasilitas", "fasilitas2": "fasilitas", "fasilitas-fasilitas": "fasilitas",
    "stratejis": "strategis", "lokasinyy": "lokasinya", "lokasinya2": "lokasinya", "ekslusif": "eksklusif", "ekslusive": "eksklusif",
    "exclusive": "eksklusif", "exlusive": "eksklusif", "bagys": "bagus", "barangny": "barangnya", "rapih": "rapi", "luas2": "luas",
    "bersih2": "bersih", "pny": "punya", "pnya": "punya", "ada2": "ada",
}

# Words without weight in this domain, and common function words of Indonesian.
DOMAIN_STOPWORDS = ["kos", "kost", "kosan", "kostan", "kos-kosan", "kamar", "sewa", "harga", "tersedia", "ready", "info", "informasi", "hubungi", "kontak"]
FUNCTION_WORDS = [
    "ada", "adalah", "agar", "akan", "antara", "apa", "atau", "bagi", "bahwa", "bila", "bisa", "dalam", "dan", "dapat", "dari", "demi",
    "dengan", "di", "dia", "hal", "harus", "hingga", "ia", "ini", "itu", "jika", "juga", "kami", "kamu", "karena", "ke", "kecuali", "kepada",
    "ketika", "kita", "lagi", "lain", "maka", "masih", "mereka", "namun", "oleh", "pada", "para", "pula", "pun", "saat", "saja", "sambil",
    "sampai", "saya", "sebab", "sebagai", "sebelum", "sehingga", "sejak", "seperti", "serta", "setelah", "sudah", "supaya", "tanpa", "tapi",
    "telah", "tentang", "tersebut", "tetapi", "tidak", "toh", "untuk", "walaupun", "ya", "yaitu", "yang",
]

# Tenant types by the substrings that tell them, in order.
TENANT_KEYWORDS = {"putra": ["putra", "pria", "cowo", "cowok", "laki"], "putri": ["putri", "wanita", "cewe", "cewek", "perempuan"], "campur": ["campur", "mix", "mixed", "umum"]}

# Tenant words of queries.
GENDER_WORDS = {
    "putra": "putra", "putri": "putri", "campur": "campur",
    "cowo": "putra", "cowok": "putra", "pria": "putra", "laki": "putra", "lk": "putra",
    "cewe": "putri", "cewek": "putri", "wanita": "putri", "perempuan": "putri", "pr": "putri", "mix": "campur",
    "girls": "putri", "girl": "putri", "women": "putri", "woman": "putri", "female": "putri", "ladies": "putri",
    "boys": "putra", "boy": "putra", "men": "putra", "male": "putra", "gentlemen": "putra",
    "mixed": "campur", "coed": "campur", "unisex": "campur",
}

# Facility words of queries and the substring they look for.
QUERY_FACILITIES = {
    "air conditioner": "ac", "ac": "ac", "wifi": "wifi", "wi-fi": "wifi", "wf": "wifi", "televisi": "tv", "tv": "tv",
    "kamar mandi dalam": "mandi dalam", "km dalam": "mandi dalam", "kmd": "mandi dalam", "wc dalam": "mandi dalam",
    "parkir mobil": "parkir mobil", "parkir motor": "parkir motor", "dapur": "dapur", "kasur": "kasur",
}

# Facilities by the substrings that tell them, in order.
FACILITY_ALIASES = {
    "ac": ["ac", "a/c", "air conditioning", "air conditioner"], "kipas angin": ["kipas angin", "kipas", "fan"], "wifi": ["wifi", "wi-fi", "internet"],
    "kamar mandi dalam": ["kamar mandi dalam", "km dlm", "km dalam", "wc dlm", "wc dalam", "kmd"],
    "kamar mandi luar": ["kamar mandi luar", "km luar", "wc luar"], "kasur": ["kasur", "tempat tidur", "spring bed", "ranjang"],
    "lemari": ["lemari pakaian", "lemari"], "meja": ["meja belajar", "meja"], "dapur": ["dapur", "kitchen"],
    "parkir motor": ["parkir motor", "parkiran motor"], "parkir mobil": ["parkir mobil", "parkiran mobil"],
    "air panas": ["air panas", "water heater", "shower panas"], "tv": ["tv", "televisi"], "kulkas": ["kulkas", "lemari es", "fridge"],
    "mesin cuci": ["mesin cuci", "laundry"],
}
