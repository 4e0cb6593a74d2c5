"""Fixed values of the Bangla operators: word lists that results depend on, in natural order."""

import unicodedata


def words(text: str) -> tuple[str, ...]:
    return tuple(unicodedata.normalize("NFC", w) for w in text.split())


NEGATION = words("না নয় নেই নাই নি ছাড়া বিনা ব্যতীত অনুপস্থিত কখনো কোনোদিন অসম্ভব")
VETO_SAFE = words("না নয় নেই নাই ছাড়া বিনা ব্যতীত নি")
DIRECTION = words("থেকে হতে চেয়ে অপেক্ষা")
YEAR_WORDS = words("সাল সালে সালের খ্রিষ্টাব্দ খ্রিস্টাব্দ খ্রিষ্টপূর্ব বঙ্গাব্দ")
MONTHS = words("জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর বৈশাখ জ্যৈষ্ঠ আষাঢ় শ্রাবণ ভাদ্র আশ্বিন কার্তিক অগ্রহায়ণ পৌষ মাঘ ফাল্গুন চৈত্র")
UNITS = words(
    "মিটার কিলোমিটার সেন্টিমিটার মিলিমিটার গজ ফুট ইঞ্চি মাইল গ্রাম কিলোগ্রাম মিলিগ্রাম টন কেজি মণ পাউন্ড লিটার মিলিলিটার ঘনমিটার বর্গমিটার বর্গকিলোমিটার হেক্টর একর "
    "সেকেন্ড মিনিট ঘণ্টা দিন সপ্তাহ মাস বছর শতাব্দী যুগ ডিগ্রি সেলসিয়াস ফারেনহাইট কেলভিন ভোল্ট অ্যাম্পিয়ার ওয়াট জুল ক্যালরি নিউটন প্যাসকেল হার্জ শতাংশ ভাগ গুণ টাকা ডলার "
    "m km cm mm kg g mg l ml s hz kw mw"
)
MARKERS = words(
    "নদী সাগর মহাসাগর উপসাগর পর্বত পাহাড় দ্বীপ বন হ্রদ জেলা উপজেলা বিভাগ শহর নগর গ্রাম রাজধানী বন্দর বিশ্ববিদ্যালয় কলেজ বিদ্যালয় মাদ্রাসা প্রতিষ্ঠান সংস্থা সরকার "
    "রাষ্ট্র দেশ সাম্রাজ্য রাজ্য দল সংগঠন মন্ত্রণালয় কমিশন যুদ্ধ আন্দোলন বিপ্লব সন্ধি চুক্তি সম্মেলন"
)
HONORIFICS = words("শেখ ড ডঃ ডক্টর স্যার মি মিস্টার অধ্যাপক কবি লেখক রাষ্ট্রপতি প্রধানমন্ত্রী সম্রাট রাজা নবাব বীর শহীদ মহাত্মা")
STOPWORDS = words(
    "এবং ও আর অথবা কিংবা বা তবে কিন্তু যদিও তথা এছাড়া অর্থাৎ তথাপি বরং এই ঐ সেই এসব ওসব যেসব এটি এটা ওটা সেটি সেটা এগুলো সেগুলো ইহা তাহা "
    "আমি আমরা আমার আমাদের তুমি তোমরা তোমার তোমাদের আপনি আপনারা আপনার সে তারা তার তাদের তিনি তাঁরা তাঁর তাঁদের নিজে নিজের "
    "যে যা যার যাদের যিনি যেটি যেটা যেখানে যখন যেহেতু যেন হয় হল হলো হয়ে হয়েছে হয়েছিল হবে হত হতো হচ্ছে হইয়া হইতে "
    "ছিল ছিলেন থাকে থাকা থেকে থাকেন রয়েছে আছে আছেন ছিলো করা করে করেন করছে করেছে করলে করার করতে করবে কর "
    "দেওয়া দিয়ে দিতে দেন দেয় নেওয়া নিয়ে নিতে জন্য সঙ্গে সাথে দ্বারা মাধ্যমে পরে আগে পূর্বে মধ্যে ভিতরে ভেতরে বাইরে "
    "উপর উপরে নিচে নীচে কাছে পাশে চারপাশে প্রতি বিরুদ্ধে অনুযায়ী মতো মত একটি একটা একজন কিছু কিছুটা অনেক অনেকে সব সকল সমস্ত প্রত্যেক প্রতিটি "
    "আরও আরো আবার এখন তখন কখনো সবসময় প্রায় খুব বেশ বেশি কম মাত্র শুধু কেবল ইত্যাদি প্রভৃতি যেমন উদাহরণস্বরূপ অর্থে বিশেষত মূলত সাধারণত "
    "তাই সুতরাং অতএব ফলে কারণে যদি তাহলে নতুবা নইলে কি কী কে কারা কোন কোনো কোনটি কখন কোথায় কেন কীভাবে কিভাবে কত কয়টি কতটি এর ওর তো ই ও হয়তো নাকি যেন বটে"
)
SUFFIX_TIERS = {
    "case": words("য়েদের েদের য়ের য়কে য়তে এতে এর ের কে তে য়ে য় রে র ে"),
    "classifier": words("খানাকে খানার খানায় খানা খানি টুকুর টুকুতে টুকু টিকে টিতে টির টাকে টাতে টার টায় জনকে জনের টই টি টা"),
    "plural": words("গুলোকে গুলোতে গুলোর গুলিকে গুলিতে গুলির গুলোয় গুলো গুলি দেরকে দেরে দের বৃন্দের বৃন্দকে বৃন্দ সমূহের সমূহকে সমূহে সমূহ গণের গণকে গণ মালার মালা রাজির রাজি েরা রা"),
    "adverbial": words("ভাবেই ভাবে তমভাবে সহকারে পূর্বক"),
}
QUESTION_WORDS = (
    (words("কে কারা কাকে কার কাদের"), "PERSON"), (words("কোথায় কোথা কোন্‌খানে কোনখানে"), "PLACE"), (words("কখন কবে"), "TIME"), (words("কেন কীজন্য কিজন্য"), "REASON"),
    (words("কীভাবে কিভাবে কেমনে"), "PROCESS"), (words("কত কতটি কয়টি কতগুলো কতজন কতটুকু কতখানি"), "NUMBER"), (words("কী কি কোনটি কোনগুলো কোন"), "THING"),
)
QUESTION_PHRASES = (
    ("কত সালে", "TIME"), ("কোন সালে", "TIME"), ("কত সালের", "TIME"), ("কত তারিখে", "TIME"), ("কোন তারিখে", "TIME"), ("কোন বছর", "TIME"), ("কত শতাব্দী", "TIME"), ("কোন সময়", "TIME"),
    ("কী কারণে", "REASON"), ("কি কারণে", "REASON"), ("কোন স্থানে", "PLACE"), ("কোন জায়গায়", "PLACE"), ("কোন দেশে", "PLACE"), ("কত সংখ্যক", "NUMBER"), ("কত শতাংশ", "NUMBER"),
)
LIST_CUES = ("কী কী", "কি কি", "কোন কোন", "কারা কারা", "কয়টি", "কতগুলো", "তালিকা", "নামগুলো")
WHAT = words("কি কী")
#: The particle of assent and that of denial, as answers to yes/no questions.
YES, NO = "হ্যাঁ", "না"
HASANT = "্"
