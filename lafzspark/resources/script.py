"""Letters, marks and character classes of Perso-Arabic script as Urdu uses it."""

# The letters, digits and marks that must be read alike for equal results.
LETTERS_FROM = "يىكګةأإۀ"
LETTERS_TO = "ییکگۃااۂ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
URDU_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
PUNCTUATION_FROM = "،؛؟۔٫٬"
PUNCTUATION_TO = ",;?..,"
HEH, ASPIRATED_HEH, ROUND_HEH = "ه", "ھ", "ہ"
ASPIRABLE = "بپتٹجچدڈکگڑ"
DIACRITICS = "[ً-ْٰٓ-ٕٖ-ٟۖ-ۭ]"
ZERO_WIDTH = "[​‎‏﻿⁠]"
TATWEEL = "ـ"
JOINERS = "[‌‍]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
SPACES = "[ \t  -   　]+"
BLANK = "\\t-\\r\\x1c-\\x20\u0085   -     　"
SHAPES = [(0xFB50, 0xFDF9), (0xFDFC, 0xFDFC), (0xFDFE, 0xFDFF), (0xFE70, 0xFEFC)]
URDU_BLOCKS = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
URDU_SCRIPT = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"
WORD_LETTERS = "ؠ-يً-ْ٠-٩ٮ-ۓە-ۿݐ-ݿﭐ-﷿ﹰ-﻿‌"
LANGUAGE_RUN = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿‌]+"
SENTENCE_ENDS = "۔؟!?."
NON_JOINING = "ادڈذرڑزژوے"

# Languages by code.
LANGUAGES = {
    "ur": "Urdu", "pnb": "Punjabi (Shahmukhi)", "skr": "Saraiki", "sd": "Sindhi", "ps": "Pashto", "ks": "Kashmiri",
    "fa": "Persian", "ar": "Arabic", "ckb": "Central Kurdish", "ug": "Uyghur", "azb": "South Azerbaijani",
}
SHORT_TEXT = 20

# Compounds and the way they are written with their space.
MERGED = {
    "کردیا": "کر دیا", "کردی": "کر دی", "کردیں": "کر دیں", "کرلیا": "کر لیا", "کرلی": "کر لی", "ہوگیا": "ہو گیا", "ہوگئی": "ہو گئی",
    "ہوگئے": "ہو گئے", "دےدیا": "دے دیا", "لےلیا": "لے لیا", "آگیا": "آ گیا", "چلاگیا": "چلا گیا", "جارہا": "جا رہا", "جارہی": "جا رہی",
    "آرہا": "آ رہا", "آرہی": "آ رہی", "کررہا": "کر رہا", "کررہی": "کر رہی", "کررہے": "کر رہے", "کرلیں": "کر لیں", "ہوگئیں": "ہو گئیں",
    "جارہے": "جا رہے", "آرہے": "آ رہے", "ہورہا": "ہو رہا", "ہورہی": "ہو رہی", "ہورہے": "ہو رہے", "دیاگیا": "دیا گیا", "کیاگیا": "کیا گیا",
    "لیاگیا": "لیا گیا", "نےکہا": "نے کہا", "کہاکہ": "کہا کہ", "نےکہاکہ": "نے کہا کہ", "میںنے": "میں نے", "آئےگا": "آئے گا", "آئےگی": "آئے گی",
    "آئیںگے": "آئیں گے", "جائےگا": "جائے گا", "جائےگی": "جائے گی", "جائیںگے": "جائیں گے", "کرےگا": "کرے گا", "کرےگی": "کرے گی", "کریںگے": "کریں گے",
}

# Stopwords and negation.
STOPWORDS = """
میں مجھے مجھ میرا میری میرے ہم ہمیں ہمارا ہماری ہمارے تم تمہیں تمہارا تمہاری تمہارے تو تیرا تیری آپ
وہ اس اسے اسکا اسکی اس کا اس کی ان انہیں انکا ان کا ان کی یہ ہے ہیں ہوں ہو ہوا ہوئی ہوئے ہوتا ہوتی ہوتے ہونا
تھا تھی تھے تھیں گا گی گے رہا رہی رہے کا کی کے کو سے پر میں تک لیے لئے ساتھ بغیر بارے وجہ
اور یا لیکن مگر پھر بھی ہی تو کہ اگر جو جب تب چونکہ کیا کیوں کیسے کہاں کب کون کتنا کتنی کتنے کس
ایک دو کچھ سب کوئی ہر بہت زیادہ کم تھوڑا کر کرنا کرتا کرتی کرتے کیا گیا گئی گئے
اب یہاں وہاں ابھی پہلے بعد دوران اوپر نیچے اندر باہر نے جس جن جنہیں جنہوں انہوں کسی کن یہی وہی اسی انہی اپنا اپنی اپنے
ایسا ایسی ایسے جیسا جیسی جیسے بلکہ کیونکہ جبکہ تاکہ یعنی والا والی والے سکتا سکتی سکتے جا جاتا جاتی جاتے جائے دیا دی دیے لیا لی ہوگا ہوگی
""".split()
NEGATION = ["نہیں", "نہ", "مت", "بغیر", "بنا"]

# Suffixes in the order in which they are tried, and words that keep theirs.
LIGHT_SUFFIXES = "ئیاں یاں یوں ئیں ؤں وں یں ئے ے ی ا".split()
SUFFIXES = "والے والی والا یاں یوں ئیاں ئیں ؤں وں یں گا گی گے تا تی تے نا نی نے ات ئے ے ی ا".split()
PROTECTED = """
سے کے کی کا کو نے ہے ہی بھی یہ وہ جو تو نہ یا اور تھا تھی تھے گا گی گے گاؤں پاؤں ہوا ہوئی ہوئے کیا کیے کئی گیا گئی گئے دیا دی دیے لیا لی لیے
ایسا ایسی ایسے ویسا جیسا جیسی جیسے کیسا کیسی کیسے اپنا اپنی اپنے میری میرا میرے تیرا تیری تیرے ہماری ہمارا ہمارے تمہاری تمہارا تمہارے
""".split()
