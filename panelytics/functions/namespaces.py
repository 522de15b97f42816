"""Title terms that mark pages outside the article namespace."""

# Results depend on these exact texts.
SPECIAL_PAGES = ["Main_Page", "-", "Search"]

# Terms per edition, matched anywhere in a title. Pass another
# mapping to ``drop_namespaces`` for further editions.
NAMESPACE_TERMS = {
    "en": [
        "User:", "Wikipedia:", "File:", "MediaWiki:", "Template:", "Help:", "Category:", "Portal:",
        "Draft:", "TimedText:", "Module:", "Special:", "Media:", "Talk:", "talk:",
    ],
    "fr": [
        "Utilisateur:", "Wikipédia:", "Fichier:", "MediaWiki:", "Modèle:", "Aide:", "Catégorie:",
        "Portail:", "Projet:", "TimedText", "Référence:", "Module:", "Gadget:", "Sujet:",
        "Discussion", "Spécial",
    ],
    "ru": [
        "Участник:", "Википедия:", "Файл:", "Шаблон:", "MediaWiki:", "TimedText:", "Справка:",
        "Категория:", "Портал:", "Инкубатор:", "Проект:", "Арбитраж:", "Модуль:", "Гаджет:",
        "Обсуждение",
    ],
    "es": [
        "Discusión:", "discusión:", "Wikipedia:", "Usuario:", "MediaWiki:", "Archivo:", "Ayuda:",
        "Categoría:", "Portal:", "Módulo:", "Plantilla:", "Wikiproyecto:", "Anexo:", "Especial:",
        "Accesorio", "Medio:",
    ],
    "pt": [
        "Discussão:", "discussão:", "Wikipédia:", "Especial:", "Usuário", "MediaWiki:", "Imagem:",
        "Ajuda:", "Categoria:", "Predefinição:", "Módulo:", "Ficheiro:", "Portal:", "Livro:",
        "talk:", "Gadget", "TimedText", "Education_Programm", "Tópico:",
    ],
    "ar": [
        "نقاش", "مستخدم", "ويكيبيديا", "ملف", "ميدياويكي", "قالب", "مساعدة", "تصنيف", "بوابة",
        "TimedText", "وحدة", "إضافة",
    ],
    "hu": [
        "Vita:", "vita:", "Wikipédia:", "Szerkesztő:", "Fájl", "MediaWiki:", "Sablon:", "Segítség:",
        "Kategória:", "Szál:", "Összefoglaló:", "Portál:", "Cikkjelölt:", "Modul:", "talk:",
        "Gadget", "TimedText",
    ],
    "fi": [
        "Keskustelu", "vita:", "Wikipedia", "Käyttäjä:", "Tiedosto", "Järjestelmäviesti", "Malline",
        "Ohje", "Luokka:", "Teemasivu:", "Metasivu:", "Kirja:", "Wikiprojekti:", "Moduuli:",
        "talk:", "Pienoisohjelma", "TimedText",
    ],
    "uz": [
        "Munozara", "munozara", "Foydalanuvchi", "Vikipediya", "Fayl", "MediaWiki", "Andoza",
        "Yordam", "Turkum:", "Portal:", "Loyiha:", "Kirja:", "Modul:", "talk:", "Gadget",
        "TimedText",
    ],
    "af": [
        "Bespreking", "bespreking", "Gebruiker", "Wikipedia", "Lêer", "MediaWiki", "Sjabloon",
        "Hulp", "Kategorie:", "Portaal:", "Module:", "talk:", "Gadget", "TimedText",
    ],
    "my": [
        "ဆွေးနွေးချက်", "အသုံးပြုသူ", "ဝီကီပီးဒီးယား", "ဖိုင်", "မီဒီယာဝီကီ", "တမ်းပလိတ်", "အကူအညီ",
        "ကဏ္", "မော်ဂျူ", "ကိရိယာငယ်", "TimedText",
    ],
    "new": [
        "खँलाबँला", "छ्येलेमि", "किपा", "मिडियाविकि", "ग्वाहालि", "पुचः", "दबू", "TimedText",
        "Module", "Gadget", "talk", "Template",
    ],
    "pms": [
        "Discussion", "Utent", "Ciaciarade", "Wikipedia", "Figura", "MediaWiki", "Stamp", "Agiut",
        "Categorìa", "TimedText", "Modulo", "Accessorio", "Definizione",
    ],
    "jv": [
        "Parembugan", "Naraguna", "Barkas", "Wikipédia", "MédhiaWiki", "Cithakan", "Pitulung",
        "Kategori", "Gapura", "TimedText", "Modhul", "Gadget", "talk",
    ],
    "pnb": [
        "گل بات", "ورتنوالا", "وکیپیڈیا", "فائل", "میڈیا وکی", "سانچہ", "ہتھونڈائی", "گٹھ",
        "ماڈیول", "TimedText", "آلہ",
    ],
}
