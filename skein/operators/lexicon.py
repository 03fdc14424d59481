"""Fixed values of query understanding: phrases and words that decide a query's class. Results depend on each of them."""

# Whole queries that are small talk.
SMALL_TALK_PHRASES = [
    "hi", "hii", "hello", "helo", "hey", "heya", "hiya", "yo", "hi there", "hello there", "hello ji", "hi ji", "namaste ji", "namaste", "namaskar", "namaskaar", "pranam", "pranaam",
    "ram ram", "radhe radhe", "sat sri akal", "jai gurudev", "jai guru", "good morning", "good afternoon", "good evening", "good night", "gm", "gn",
    "how are you", "how are you doing", "how r u", "how are u", "how do you do", "hows it going", "how s it going", "how is it going", "whats up", "what s up", "wassup", "sup",
    "kaise ho", "kaise hain", "kaise hain aap", "kaise ho aap", "kaisa hai", "kya haal", "kya haal hai", "kya haal chaal", "kya chal raha hai",
    "thanks", "thank you", "thankyou", "thx", "ty", "thank u", "dhanyavaad", "dhanyawad", "shukriya",
    "bye", "goodbye", "good bye", "alvida", "tata", "ok bye", "see you", "see ya", "ok", "okay", "cool", "nice", "great",
    "who are you", "what are you", "what is this", "what is this app", "what can you do", "what do you do", "what can i ask", "how does this work",
    "are you a bot", "are you ai", "are you real", "help", "help me", "tum kaun ho", "aap kaun ho", "tum kya kar sakte ho", "aap kya kar sakte ho",
    "नमस्ते", "नमस्कार", "प्रणाम", "राम राम", "राधे राधे", "सत श्री अकाल", "हैलो", "हेलो", "कैसे हो", "कैसे हैं", "कैसे हैं आप", "क्या हाल",
    "क्या हाल है", "क्या चल रहा है", "धन्यवाद", "शुक्रिया", "अलविदा", "तुम कौन हो", "आप कौन हो",
]
# Words that greet, thank or address the assistant.
ADDRESSES = [
    "hi", "hii", "hello", "helo", "hey", "heya", "hiya", "yo", "namaste", "namaskar", "namaskaar", "pranam", "pranaam", "wassup", "sup", "bye", "goodbye", "tata", "alvida",
    "thanks", "thank", "thankyou", "thx", "ty", "dhanyavaad", "dhanyawad", "shukriya", "gm", "gn", "you", "u", "your", "yourself", "tum", "aap",
    "app", "dashboard", "bot", "ai", "assistant", "chatbot", "help", "madad",
    "नमस्ते", "नमस्कार", "प्रणाम", "हैलो", "हेलो", "धन्यवाद", "शुक्रिया", "अलविदा", "आप", "तुम", "मदद",
]
# Words without content that may stand beside an address.
EMPTY_WORDS = [
    "good", "morning", "afternoon", "evening", "night", "ok", "okay", "what", "who", "how", "why", "are", "is", "am", "do", "does", "did",
    "can", "could", "would", "should", "tell", "say", "ask", "know", "i", "me", "my", "we", "a", "an", "the", "this", "there", "here", "for", "of", "and",
    "about", "things", "stuff", "question", "questions", "answer", "answers", "name", "please", "plz", "so", "much", "ji",
    "kya", "kar", "karo", "sakte", "sakta", "sakti", "ho", "hain", "hai", "kaun", "kaise", "mujhe", "batao", "bata", "kripya",
    "क्या", "कर", "करो", "सकते", "सकती", "सकता", "हो", "हैं", "है", "कौन", "कैसे", "मुझे", "बताओ", "जी", "कृपया",
]
# People that are asked for often, in Devanagari (whole words) and romanised (anywhere).
PEOPLE = [
    "विवेकानंद", "रामतीर्थ", "रामकृष्ण", "नामदेव", "नानक", "कबीर", "मीरा", "मीराबाई", "बुद्ध", "कृष्ण", "अर्जुन", "प्रह्लाद", "ध्रुव", "गोरखनाथ",
    "रैदास", "तुलसीदास", "सूरदास", "शुकदेव", "नरसी",
]
ROMAN_PEOPLE = ["vivekananda", "rama tirtha", "ramtirth", "ramakrishna", "namdev", "nanak", "kabir", "meera", "mira", "buddha", "krishna", "arjuna"]
# Endings of names, and forms of address of teachers, who are no subject of a question.
NAME_ENDINGS = ["सिंह", "देव", "दास", "नाथ", "तीर्थ", "प्रसाद"]
TEACHERS = ["स्वामी", "गुरु", "गुरुजी", "गुरुदेव", "सद्गुरु", "सतगुरु", "ऋषि", "बाबा", "महाराज"]
# Concepts and particles that are no part of a name.
CONCEPTS = [
    "क्रोध", "ध्यान", "प्रेम", "भक्ति", "मन", "समर्पण", "वैराग्य", "अहंकार", "मोक्ष", "माया", "आत्मा", "परमात्मा", "शांति", "करुणा", "सेवा", "साधना",
    "ज्ञान", "कर्म", "योग", "मृत्यु", "जीवन", "सत्य", "आनंद", "श्रद्धा",
]
PARTICLES = [
    "के", "का", "की", "को", "में", "से", "पर", "और", "या", "है", "हैं", "कोई", "किस", "किन", "क्या", "कौन", "कहाँ", "कहां", "कब", "कैसे", "क्यों",
    "बारे", "ज़िक्र", "जिक्र", "कथा", "कहानी", "नाम", "बात", "जी", "ने",
]
# The same, romanised and in English.
ROMAN_CONCEPTS = [
    "dhyan", "dhyaan", "prem", "bhakti", "krodh", "gussa", "man", "samarpan", "vairagya", "ahankar", "moksha", "maya", "atma", "aatma", "paramatma",
    "shanti", "karuna", "seva", "sadhana", "gyan", "gyaan", "karma", "yog", "yoga", "mrityu", "jeevan", "satya", "anand", "shraddha", "meditation",
    "love", "anger", "devotion", "surrender", "death", "life", "truth",
]
ROMAN_PARTICLES = [
    "ke", "ka", "ki", "ko", "mein", "me", "se", "par", "aur", "ya", "hai", "hain", "koi", "kis", "kin", "kya", "kaun", "kahan", "kab", "kaise",
    "kyon", "kyu", "kyun", "bare", "baare", "zikr", "jikr", "katha", "kahani", "kahaani", "naam", "baat", "ji", "ne", "tha", "the", "thi",
    "about", "what", "who", "did", "say", "said", "tell", "does",
]
ROMAN_TEACHERS = ["swami", "guru", "guruji", "gurudev", "sadguru", "satguru", "baba", "maharaj", "rishi"]
