"""Taxonomy, lexicons and thresholds.

Every operator takes these as parameters; the module only holds the defaults.
The blocks marked "fixed values" are data, not logic: they decide which rows get
which label, so they are kept literally and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: label domains (order decides arg-max ties) -----------------
STANCES = [
    "supports_subject",
    "opposes_subject",
    "criticises_judiciary",
    "criticises_government",
    "informational",
    "unclear",
]
EMOTIONS = ["anger", "grief", "cynicism", "hope", "neutral"]
SPAM_CLASSES = ["not_spam", "spam"]
TASKS = {"spam": SPAM_CLASSES, "stance": STANCES, "emotion": EMOTIONS}
UNCLEAR, NEUTRAL = "unclear", "neutral"

# ---- fixed values: event phases, inclusive upper date bounds ------------------
PHASES = [("2025-12-31", "f1"), ("2026-04-30", "f2"), ("2026-06-28", "f3"), (None, "f4")]
PHASE_FLOORS = {"f1": 30, "f2": 60, "f3": 120, "f4": 200}

# ---- fixed values: emoji code-point ranges and invisible companions -----------
EMOJI_RANGES = [
    (0x1F000, 0x1FAFF),
    (0x2600, 0x27BF),
    (0x2B00, 0x2BFF),
    (0x2190, 0x21FF),
    (0x2300, 0x23FF),
    (0x25A0, 0x25FF),
]
EMOJI_COMPANIONS = [0xFE0E, 0xFE0F, 0x200D, 0x20E3]

# ---- fixed values: emoji that decide the emotion of an emoji-only comment -----
EMOJI_EMOTION = {
    "grief": "😭😢💔🥀🥺🥹🥲😔😞😥😪☹🙁😿",
    "cynicism": "😂🤣😅😏🙃😆",
    "anger": "😡🤬💢👎😠",
    "hope": "🙏🤲💪✊❤🔥🫶💚🤍❣💜🩷🧡💛💙👏🙌✨🌟😇",
}

# ---- fixed values: spam vocabulary, matched on NFKC + case-folded text --------
SPAM_TERMS = [
    "slot", "gacor", "maxwin", "max win", "jackpot", "jekpot", r"\bjp\b", r"\brtp\b", r"\bwd\b",
    "zoyamax", "kolemax", "dikasih menang", "di kasih menang", "bawa modal", r"modal \d+",
    "jasa bor", "bor sumur", "sedot wc", "sumur bor",
    "olshop", "open order", "open jasa", "promo", "giveaway", "cek profil", "link di bio",
    "bonus new member", r"depo(?:sit)?\b",
]

# ---- fixed values: topic vocabulary, matched on lower-case clean text ---------
TOPIC_TERMS = {
    "judge_pay": [
        "gaji hakim", r"naik.{0,6}(280|300|hampir 300)", r"280\s*%", r"300\s*%", "kenaikan gaji",
    ],
    "judiciary": [
        r"\bhakim\b", r"\bjaksa\b", r"\bvonis\b", "pengadilan", "sidang", "dakwaan", "tuntutan",
        "yang mulia", "kejaksaan", r"\bkpk\b", "hukuman", "banding", "kasasi", "penjara", "terdakwa",
        "keadilan",
    ],
    "devices": [
        "chromebook", "chrome ?os", "laptop", r"\bgoogle\b", "pengadaan", "e-?katalog",
        "digitalisasi", "perangkat", "mark ?up", "9[.,]3 ?trili",
    ],
    "curriculum": [
        "kurikulum", "merdeka belajar", "pendidikan", "guru", "sekolah", "siswa", "ujian nasional",
        "zonasi", "mendikbud", "anbk",
    ],
    "gig_work": [
        "gojek", "go-?jek", "ojol", "driver", "grab", "lapangan (kerja|pekerjaan)", r"\bceo\b",
        "startup",
    ],
    "politics": [
        "jokowi", "mulyono", "prabowo", "gibran", "presiden", "pemerintah", "rezim", "istana",
        r"\bdpr\b", "partai", "menteri", "tom lembong", "negara", "konoha",
    ],
    "faith_morals": [
        "allah", "tuhan", "akhirat", "dosa", "azab", "karma", "doa", "zolim", "zalim", "dzolim",
        "neraka", "surga", "amin", "aamiin", "insya",
    ],
}

# ---- fixed values: stop-words of the vocabulary reports -----------------------
STOP_WORDS = """
yang yg dan di ke dari ini itu untuk utk pada dengan dgn atau juga sudah udah akan agar saja aja
adalah ada tidak tak tdk gak ga nggak enggak bukan karena krn kalau kalo klo jika bila maka supaya
sebagai oleh dalam tentang hingga sampai sejak setelah sebelum saat ketika namun tetapi tapi walau
meski aku saya gue gua gw kamu kau kalian kita kami dia mereka nya ku mu anda bang kak mas mbak bu
pak om tante guys gaes sih dong deh kok kan tuh nih loh lah ya yah kek kayak kaya gitu gini begitu
begini banget bgt amat sekali emang memang mah lagi lg udh blm belum masih mesti harus biar buat
punya jadi jd bikin ah eh oh wah wkwk wkwkwk haha hahaha hehe hmm si para pun per bisa boleh mau
ingin pengen pengin semua sama sm lebih paling sangat cuma hanya doang kenapa gimana gmn bagaimana
apa apakah siapa mana kapan dimana kemana berapa yaa orang org
""".split()

# ---- fixed values: account names that are placeholders, never hashed ----------
ACCOUNT_SENTINELS = ["", "none", "null", "-"]
MENTION_PATTERN = r"@([A-Za-z0-9_][A-Za-z0-9_.]{0,29})"

# ---- fixed values: thresholds -------------------------------------------------
SHORT_TEXT, NORMAL_TEXT = 25, 200
SOURCE_WEIGHTS = {"gold": 1.0, "silver": 0.4}
SPLIT_FRACTIONS = {"test": 0.40, "val": 0.15}
TEMPERATURE_RANGE = (0.5, 5.0)
ABSTAIN_TARGET = 0.80
SMALL_SUPPORT = 20
CLASS_WEIGHT_CLIP = (0.3, 4.0)
FONT_SIZE_RANGE = (13.0, 48.0)
SEED = 42

STANCE_LABELS = {
    "supports_subject": "Supports the subject",
    "opposes_subject": "Opposes the subject",
    "criticises_judiciary": "Criticises the judiciary",
    "criticises_government": "Criticises the government",
    "informational": "Neutral / informational",
    "unclear": "Unclear",
}
EMOTION_LABELS = {e: e.capitalize() for e in EMOTIONS}
PHASE_LABELS = {
    "f1": "First reports",
    "f2": "Early proceedings",
    "f3": "Detention",
    "f4": "Trial and verdict",
}
TOPIC_LABELS = {
    "judge_pay": "Pay rise for judges",
    "judiciary": "Court proceedings",
    "devices": "Device procurement",
    "curriculum": "Curriculum & education",
    "gig_work": "Gig work & jobs",
    "politics": "National politics",
    "faith_morals": "Faith & morals",
}

DEFAULT_PROMPT = (
    "You label short social-media comments about a public legal case. "
    'Answer with one JSON object {"spam": bool, "stance": string, "emotion": string}. '
    "Code only the target that is written out; when two stances are equally likely answer "
    "unclear. Label sarcasm by its intended meaning with emotion cynicism."
)


@dataclass(frozen=True)
class SamplingPlan:
    """Quotas of the two annotation samples."""

    gold_target: int = 600
    silver_target: int = 3000
    top_liked: int = 30
    spam_quota: int = 40
    emoji_quota: int = 60
    phase_floors: dict = field(default_factory=lambda: dict(PHASE_FLOORS))
    seed: int = SEED
