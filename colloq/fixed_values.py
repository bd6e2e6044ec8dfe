"""Word lists, tables and patterns that results depend on.

All are defaults; every operator takes its own lists as parameters.
"""

from __future__ import annotations

#: Capitalised words that start no full name.
NON_NAMES = (
    "Γεια", "Γειά", "Καλημέρα", "Καλησπέρα", "Καληνύχτα", "Ευχαριστώ", "Παρακαλώ", "Συγγνώμη", "Συγνώμη", "Χαίρετε",
    "Ναι", "Όχι", "Οχι", "Καλά", "Καλό", "Καλή", "Εντάξει", "Οκ", "Λοιπόν", "Τέλεια", "Ωραία", "Ωραίο", "Μπράβο",
    "Έγινε", "Εγινε", "Αύριο", "Σήμερα", "Χθες", "Τώρα", "Μετά", "Πριν", "Ίσως", "Πάμε", "Έλα", "Ελα", "Άντε", "Αντε",
    "Δες", "Πες", "Κοίτα", "Δευτέρα", "Τρίτη", "Τετάρτη", "Πέμπτη", "Παρασκευή", "Σάββατο", "Κυριακή", "Ιανουάριος",
    "Φεβρουάριος", "Μάρτιος", "Απρίλιος", "Μάιος", "Ιούνιος", "Ιούλιος", "Αύγουστος", "Σεπτέμβριος", "Οκτώβριος",
    "Νοέμβριος", "Δεκέμβριος", "Πάσχα", "Χριστούγεννα", "Πρωτοχρονιά", "Θεέ", "Παναγία", "Χριστός", "Αθήνα",
    "Θεσσαλονίκη", "Ελλάδα", "Πάτρα", "Τρίπολη",
)

#: Stems of given names.
GIVEN_NAME_STEMS = (
    "παναγιωτ", "δημητρ", "γιανν", "ιωανν", "κωνσταντιν", "κωστ", "αποστολ", "αθανασ", "θαναση", "βασιλ", "νικολ",
    "χρηστ", "μιχαλ", "μιχαηλ", "αντων", "στελ", "στυλιαν", "πετρ", "θεοδωρ", "σπυρ", "ανδρε", "αλεξανδρ", "εμμανου",
    "μανωλ", "ηλια", "λευτερ", "ελευθερ", "σωτηρ", "χαραλαμπ", "λαμπρ", "μανθ", "θωμα", "στεφαν", "γρηγορ", "παυλ",
    "μαρκ", "αργυρ", "βαγγελ", "ευαγγελ", "ζαχαρ", "κυριακ", "λεωνιδ", "ορεστ", "περικλ", "σαββ", "φιλιππ", "χριστοφ",
    "μαρι", "ελεν", "κατεριν", "αικατεριν", "σοφι", "γιωτ", "παναγιωτα", "δημητρα", "βασιλικ", "αναστασ", "αννα",
    "χριστιν", "ευαγγελι", "ιωανν", "δεσποιν", "ελισαβετ", "ευτυχ", "θεοδωρα", "ιουλι", "καλλιοπ", "κυριακη", "λαμπριν",
    "μαγδαλ", "νικολετ", "ολγα", "παρασκευ", "πηνελοπ", "ραφαηλ", "σταυρ", "στεργ", "τριανταφυλλ", "φανη", "φωτειν",
    "χαρικλ", "χρυσ", "αγγελικ", "αδαμαντ", "αλεξανδρα", "αμαλι", "ανδρομαχ", "αρετ", "αρτεμ", "ασπασ", "αφροδιτ",
    "βαρβαρ", "γεωργι", "ειρην", "ελπιδ", "ερασμ", "ευαγγελια", "ευανθ", "θαλει", "θεοφαν", "κλεοπατρ", "κωνσταντιν",
    "λεμον", "μαργαριτ", "μελπομεν", "ξανθ", "ουρανι", "πολυξεν", "σμαραγδ", "σταματ", "τερψ", "υπαπαντ", "φιλοθε",
)

#: Endings of given names.
NAME_ENDINGS = (
    "ιτσα", "ουλα", "ακης", "ακη", "ακι", "ιδης", "ιδη", "οπουλος", "οπουλου", "ος", "ας", "ης", "ες", "ους", "ους",
    "ου", "ων", "οι", "ες", "α", "η", "ο", "ε", "ς", "ι", "ω", "",
)

#: Days, months and places that look like given names.
CALENDAR_AND_PLACES = (
    "παρασκευη", "παρασκευης", "παρασκευες", "κυριακη", "κυριακης", "κυριακες", "ιουλιος", "ιουλιου", "ιουλιο", "ιουλη",
    "ιουνιος", "ιουνιου", "ιουνιο", "μαρτιος", "μαρτιου", "μαρτιο", "αυγουστος", "αυγουστου", "αυγουστο", "γιαννιτσα",
    "γιαννιτσων", "γιαννιτσας", "μαρκοπουλο", "μαρκοπουλου", "αγιαννη", "αγιαννης",
)

#: Ordinary words that look like given names.
NAME_LIKE_WORDS = (
    "νικη", "νικης", "νικο", "νικα", "χαρα", "χαρας", "ελπιδα", "ελπιδας", "φως", "φωτα", "φωτο", "μαρκα", "μαρκας",
    "ωρα", "ωρες",
)

#: Given names that take no further endings.
EXACT_GIVEN_NAMES = (
    "νικος", "νικο", "νικου", "ευα", "ευας", "ζωη", "ζωης", "τασος", "τασο", "τασου", "φωτης", "φωτη",
)

#: Endings of surnames.
SURNAME_SUFFIXES = (
    "οπουλος", "οπουλου", "οπουλο", "ιδης", "ιδη", "ιδου", "ιδων", "ιαδης", "ιαδη", "ιαδου", "ακης", "ακη", "ακηδες",
    "ογλου", "ουδης", "ουδη", "ακος", "ακου", "ελλης", "ελλη", "εας",
)

#: Endings of adjectives that look like surnames.
ADJECTIVAL_ENDINGS = (
    "ιακη", "ιακης", "ιακο", "ιακου",
)

#: Ordinary words that look like surnames.
NOT_SURNAMES = (
    "ελπιδα", "ελπιδη", "παιδη", "παιδι", "κλειδη", "κλειδι", "σελιδα", "σελιδη", "μεριδα", "μεριδη", "πατριδα",
    "πατριδη", "ασπιδα", "σφραγιδα", "χλωριδα", "πυραμιδα", "ολυμπιαδα", "εβδομαδα", "φυλακη", "θηκη", "αποθηκη",
    "βιβλιοθηκη", "συνθηκη", "υποθηκη", "μαλακη", "ιδεα", "παρεα", "γραμμεα", "συγγραφεα", "γονεα", "ιππεα", "φονεα",
    "κουρεα", "ιερεα", "βασιλεα", "θανατος", "θανατου", "καματος", "πλατος", "κρατος", "κρατους", "γεματος", "αρματος",
    "ονοματος", "χρηματος", "πραγματος", "συστηματος", "θεματος", "προβληματος", "αιματος", "σωματος", "κτηματος",
    "τμηματος", "ρευματος", "κληματος", "βληματος", "στοματος", "ποσοστου", "κοστους", "κοτοπουλο", "κοτοπουλα",
    "κοτοπουλου", "αρχοντοπουλο", "μακρακος", "θεση", "θεσης", "προθεση", "καταθεση", "συνθεση", "διαθεση", "επιθεση",
    "αφαιρεση", "διαιρεση", "παρεση", "αιρεση", "περιπτωση", "αποφαση", "σκεψη", "λεση", "πεση", "αντιθεση", "υποθεση",
    "παραθεση", "εκθεση", "μεταθεση", "προσθεση", "ενθεση", "επειδη", "ειδη", "ειδηση", "ειδησεις", "συνηθεια",
    "κυριακη", "κυριακης", "μαλακη", "μαλακια", "κατοικη", "τραγουδη", "τραγουδι", "λουλουδη", "λουλουδι", "χνουδη",
    "γραμματεας", "συγγραφεας", "γονεας", "ιππεας", "φονεας", "κουρεας", "ιερεας", "βασιλεας", "μεταφορεας",
    "εργαζομενος", "αποστολεας", "παραλαβεας", "εισαγωγεας", "εξαγωγεας", "χειριστεας", "επεειδη", "επιδη", "επειδι",
)

#: Places that look like surnames.
PLACE_NAMES = (
    "μαρκοπουλο", "μαρκοπουλου", "γιαννιτσα", "γιαννιτσων", "θεσσαλονικη", "θεσσαλονικης", "τριπολη", "τριπολης",
    "κερκυρα", "κερκυρας", "καλαματα", "καλαματας", "χαλκιδικη", "χαλκιδικης", "αττικη", "αττικης", "κρητη", "κρητης",
    "ροδοπη", "ροδοπης", "αρκαδια", "πελοποννησο", "πελοποννησου", "μακεδονια", "θρακη",
)

#: A question that takes an event for granted, and what replaces a claim about a calendar that was not read.
PRESUPPOSES_EVENT = (
    r"\b(?:θα|να)\s+\w+(?:ουμε|ούμε|ομαστε|όμαστε)\b"
    r"|\bτι\s+ωρα\s+(?:θα|ειναι)\b"
    r"|\b(?:η|την|στη|στην)\s+(?:συναντηση|εκδηλωση|παρουσιαση|δοκιμη|προβα|εξεταση|τελετη)\b"
    r"|\b(?:το|στο)\s+(?:ραντεβου|μαθημα|meeting|call)\b"
    r"|\bαυτο\s+που\s+(?:ειπαμε|λεγαμε|κανονισαμε)\b"
)
SCHEDULE_REFUSAL = "Δεν μπορώ να δω το ημερολόγιό μου τώρα, οπότε δεν ξέρω τι έχω. Πες μου τι ώρα σε βολεύει και το κοιτάζω."
SCHEDULE_ASK_WHICH = "Σε τι αναφέρεσαι; Δεν μπορώ να δω το ημερολόγιό μου αυτή τη στιγμή, οπότε πες μου για ποιο πράγμα λες και τα κανονίζουμε."

#: Places in a sentence where a name is expected; the name is the one capturing group.
NAME_FRAMES = (
    r"\b(?:στον|στην|στου|στης)\s+([^\W\d_]{4,})",
    r"\b(?:του|της|τον|την)\s+([^\W\d_]{4,})",
    r"\b(?:με|απο|για)\s+τον?\s+([^\W\d_]{4,})",
    r"\bκ\.\s*([^\W\d_]{4,})",
    r"\b(?:κυριο|κυριε|κυρια)\s+([^\W\d_]{4,})",
    r"\b(?:ο|η)\s+([^\W\d_]{4,})\s+(?:ειπε|λεει|ελεγε|εστειλε|ρωτησε)",
    r"\b(?:στειλε|στειλ|γραψε|ρωτα|ρωτησε|πες)\s+(?:στον|στην|του|της)?\s*([^\W\d_]{4,})",
)

#: Words that stand where names do and are none.
FRAME_NOISE = (
    "εαυτο", "εαυτου", "αρχη", "αρχης", "ωρα", "ωρας", "μερα", "μερας", "δουλεια", "δουλειας", "σχολη", "σχολης",
    "σπιτι", "σπιτιου", "αλλο", "αλλη", "αλλον", "ιδιο", "ιδια", "καθε", "οποιο", "οποια", "πρωτο", "πρωτη",
    "τελευταιο", "τελευταια", "θεμα", "θεματος", "εβδομαδα", "εβδομαδας", "μηνα", "χρονο", "χρονια", "βραδυ", "πρωι",
    "απογευμα", "τηλεφωνο", "μαιλ", "email", "μηνυμα", "παιδι", "παιδια", "κοσμο", "κοσμος", "ανθρωπο", "ανθρωπος",
    "εταιρεια", "εταιρειας", "γραφειο", "μαγαζι", "νοσοκομειο", "πανεπιστημιο", "τραπεζα", "τραπεζας", "αυτοκινητο",
    "μηχανη",
)

#: Words without accents and their spelling.
ACCENTS = {
    "ειναι": "είναι", "εχω": "έχω", "εχει": "έχει", "εχεις": "έχεις", "εχουμε": "έχουμε", "κανω": "κάνω",
    "κανεις": "κάνεις", "κανει": "κάνει", "κανουμε": "κάνουμε", "θελω": "θέλω", "θελεις": "θέλεις", "θελει": "θέλει",
    "μπορω": "μπορώ", "μπορεις": "μπορείς", "μπορει": "μπορεί", "πρεπει": "πρέπει", "παω": "πάω", "παμε": "πάμε",
    "πηγαινω": "πηγαίνω", "ξερω": "ξέρω", "ξερεις": "ξέρεις", "λεω": "λέω", "λεει": "λέει", "βλεπω": "βλέπω",
    "βλεπεις": "βλέπεις", "δουλευω": "δουλεύω", "δουλευεις": "δουλεύεις", "ερχομαι": "έρχομαι", "φευγω": "φεύγω",
    "περιμενω": "περιμένω", "περιμενε": "περίμενε", "στελνω": "στέλνω", "βαζω": "βάζω", "παιρνω": "παίρνω",
    "δινω": "δίνω", "βρισκω": "βρίσκω", "ψαχνω": "ψάχνω", "αρχιζω": "αρχίζω", "τελειωνω": "τελειώνω",
    "εννοειται": "εννοείται", "νομιζω": "νομίζω", "φαινεται": "φαίνεται", "ακουω": "ακούω", "βοηθαω": "βοηθάω",
    "αλλαζω": "αλλάζω", "εγω": "εγώ", "εσυ": "εσύ", "αυτο": "αυτό", "αυτη": "αυτή", "αυτος": "αυτός", "ολα": "όλα",
    "ολοι": "όλοι", "κατι": "κάτι", "ποιος": "ποιός", "ποτε": "πότε", "πως": "πώς", "που": "πού", "καλα": "καλά",
    "τωρα": "τώρα", "μετα": "μετά", "εδω": "εδώ", "εκει": "εκεί", "γιατι": "γιατί", "πολυ": "πολύ", "αλλα": "αλλά",
    "ομως": "όμως", "οταν": "όταν", "αφου": "αφού", "επισης": "επίσης", "ισως": "ίσως", "βεβαια": "βέβαια",
    "μονο": "μόνο", "ακομα": "ακόμα", "αμεσα": "άμεσα", "γρηγορα": "γρήγορα", "ευκολα": "εύκολα", "απλα": "απλά",
    "σιγουρα": "σίγουρα", "ετσι": "έτσι", "αυριο": "αύριο", "χτες": "χθες", "σημερα": "σήμερα", "οχι": "όχι",
    "μαζι": "μαζί", "κιολας": "κιόλας", "αμεσως": "αμέσως", "τελικα": "τελικά", "αρκετα": "αρκετά",
    "δουλεια": "δουλειά", "ωρα": "ώρα", "μερα": "μέρα", "νερο": "νερό", "φιλε": "φίλε", "φιλαρακι": "φιλαράκι",
    "αδερφε": "αδερφέ", "πληροφορικη": "πληροφορική", "εταιρεια": "εταιρεία", "προβλημα": "πρόβλημα", "θεμα": "θέμα",
    "λυση": "λύση", "ωραια": "ωραία", "καλημερα": "καλημέρα", "καλησπερα": "καλησπέρα", "ευχαριστω": "ευχαριστώ",
    "παρακαλω": "παρακαλώ", "καλος": "καλός", "καλη": "καλή", "καλο": "καλό", "νεος": "νέος", "νεα": "νέα",
    "νεο": "νέο", "μεγαλος": "μεγάλος", "μεγαλη": "μεγάλη", "μικρος": "μικρός", "σωστο": "σωστό", "σωστα": "σωστά",
}

#: Stems of rude words and what replaces them.
SOFTENED = {
    "γαμησετα": "άστα να πάνε", "γαμω": "ωχ", "μαλακα": "φίλε", "σκατα": "χάλια",
}

#: Stems of words that are removed.
BLOCKED_STEMS = (
    "γαμησ", "γαμω", "γαμωτ", "γαμημ", "πουταν", "μουν", "αρχιδ", "πουστ", "καριολ", "μαλακισμεν", "μπινε", "σκατ",
    "χεσ", "κωλοπαιδ", "βλαμμεν", "ηλιθι", "κωλο",
)

#: Particles that are removed.
IMPOLITE = (
    "ρε",
)

#: Familiar forms of address (patterns over unaccented text).
VOCATIVES = (
    r"φιλαρακι(?:\s+μ(?:ου)?)?", r"φιλε", r"φιλαρα", r"αδερφε", r"αδελφε", r"μεγαλε", r"αρχηγε", r"μαστορα", r"τρελε",
    r"αγορι\s+μ(?:ου)?", r"κουκλα\s+μ(?:ου)?", r"μανα\s+μ(?:ου)?", r"ψυχη\s+μ(?:ου)?",
)

#: Names that are removed at the start of a reply.
LEADING_NAMES = (
    "παναγιωτη", "γιωτη", "χρηστο", "μαρια", "νικο", "δημητρη", "κωστα", "γιαννη", "σπυρο", "αντωνη", "μιχαλη",
    "βασιλη",
)

#: Weighted patterns of each intent, in order of priority.
INTENT_PATTERNS = (
    ("sensitive", (
        (r"\b(λεφτα|λεφτά|χρηματα|χρήματα|πληρωμ[ηή]|μεταφορ[αά])\b", 0.8),
        (r"\b(τραπεζ[αά]|iban|λογαριασμ[οό])\b", 0.85),
        (r"\b(δικηγορ[οό]|νομικ[αάοό]|αγωγ[ηή])\b", 0.8),
        (r"\b(γιατρ[οό]|νοσοκομει[οό]|αρρωστ|φαρμακ)\b", 0.75),
        (r"\b(αφμ|αμκα|ταυτοτητ[αά]ς?|ταυτότητ[αά]ς?)\b", 0.9),
        (r"\b(κωδικ[οό]ς?\s+(τραπεζ|πιστωτικ))\b", 0.95),
        (r"\bpassword\b", 0.7),
    )),
    ("schedule", (
        (r"\b(διαθεσιμ[οό]ς?|διαθέσιμ[οό]ς?)\b", 0.9),
        (r"\b(ελευθερ[οό]ς?|ελεύθερ[οό]ς?)\b", 0.85),
        (r"\bεχεις\s+(χρονο|χρόνο|ωρα|ώρα)\b", 0.85),
        (r"\bέχεις\s+(χρόνο|ώρα)\b", 0.85),
        (r"\b(ποτε|πότε)\s+(μπορ[εεί]ς?|εισαι|είσαι|θα|εχεις|έχεις)\b", 0.9),
        (r"\b(ποτε|πότε)\s+(μπορεις|μπορείς)\b", 0.9),
        (r"\b(ραντεβου|ραντεβού|meeting|συναντηση|συνάντηση)\b", 0.85),
        (r"\b(calendar|ημερολογι[οό]|ημερολόγι[οό])\b", 0.9),
        (r"\b(προγραμμα|πρόγραμμα)\s+(σου|εχεις|έχεις|σημερα|σήμερα|αυριο|αύριο)\b", 0.85),
        (r"\b(αυριο|αύριο|μεθαυριο|μεθαύριο)\s+.*(βολευει|βολεύει|κανει|κάνει)\b", 0.85),
        (r"\b(σημερα|σήμερα)\s+(το\s+)?(απογευμα|απόγευμα|βραδυ|βράδυ|μεσημερ)\b", 0.8),
        (r"\b(τι|τί)\s+(θα\s+)?(κανεις|κάνεις|εχεις|έχεις)\b[^;.!?]{0,20}\b(αυριο|αύριο|σημερα|σήμερα|μεθαυριο|μεθαύριο|το\s+σαββατοκυριακο)\b", 0.88),
        (r"\b(αυριο|αύριο|μεθαυριο|μεθαύριο)\s+(το\s+)?(πρωι|πρωί|απογευμα|απόγευμα|βραδυ|βράδυ|μεσημερ\w*)\b", 0.85),
        (r"\b(δευτερα|τριτη|τεταρτη|πεμπτη|παρασκευη|σαββατο|κυριακη)\b", 0.75),
        (r"\b(δευτέρα|τρίτη|τετάρτη|πέμπτη|παρασκευή|σάββατο|κυριακή)\b", 0.75),
        (r"\b(παμε|πάμε)\s+(να|για)\b.*\b(αυριο|αύριο|σημερα|σήμερα|βραδυ|βράδυ)\b", 0.85),
        (r"\bθες\s+να\s+(βρεθουμε|βρεθούμε|συναντηθ)\b", 0.85),
        (r"\b(ποτε|πότε)\s+.*\b(βρεθουμε|βρεθούμε)\b", 0.85),
    )),
    ("memory", (
        (r"\b(παραγγελ[ιία]|παράγγειλ|order)\b", 0.9),
        (r"\b(ρουχα|ρούχα|παπουτσ|παπούτσ)\b", 0.75),
        (r"\b(tracking|αποστολ[ηή]|courier|acs|speedex|ελτα|elta)\b", 0.85),
        (r"\b(αγορ[αά]|αγόρασ)\b", 0.8),
        (r"\b(τιμολογ[ιί]ο?|invoice|αποδειξ[ηή]|receipt)\b", 0.85),
        (r"\bτι\s+(εγινε|έγινε)\s+(με|για)\b", 0.85),
        (r"\bτι\s+(γινεται|γίνεται)\s+(με|για)\b", 0.8),
        (r"\b(θυμασαι|θυμάσαι)\s+(αν|τι|ποτε|πότε)\b", 0.8),
        (r"\b(ηρθε|ήρθε|εφτασε|έφτασε)\s+(το|η|τα)\b", 0.8),
        (r"\b(email|mail|μειλ|μηνυμα|μήνυμα)\s+(απο|από)\b", 0.85),
        (r"\b(απαντησ[αε]|απάντησ[αε])\s+(στο|στον|στην)\b", 0.75),
        (r"\b(συνδρομ[ηή]|subscription)\b", 0.8),
        (r"\b(λογαριασμ[οό]ς?\s+(ρεύμα|νερ[οό]|κινητ))\b", 0.8),
        (r"\b(πληρω[σσ]|πλήρωσ)\b", 0.7),
    )),
    ("devops", (
        (r"\b(commit|commits|pushed|push)\b", 0.9),
        (r"\b(pull\s*request|pr|merge)\b", 0.85),
        (r"\b(issue|issues|bug|bugs)\b", 0.8),
        (r"\b(github|gitlab|repo|repository)\b", 0.9),
        (r"\b(deploy|deployment|release)\b", 0.8),
        (r"\b(branch|branches|main|master)\b", 0.75),
        (r"\b(κωδικ[αά]|κώδικ[αά])\s+(σημερα|σήμερα|χτες|χθες)\b", 0.85),
        (r"\b(τι|τί)\s+(εκανες|έκανες)\s+.*(code|coding|κωδικ)\b", 0.8),
        (r"\b(ανοιχτ[αάοό])\s+(issue|pr|ticket)\b", 0.85),
        (r"\b(pipeline|ci|cd|build)\b", 0.75),
    )),
    ("weather", (
        (r"\b(καιρ[οό]ς?|καιρός?)\b", 0.95),
        (r"\b(weather)\b", 0.9),
        (r"\b(βρ[εέ]ξ[εη]ι?|βροχ[ηή]|χιον[ιί])\b", 0.9),
        (r"\b(ζεστ[αάηή]|κρυ[οό]|κρύο)\b", 0.75),
        (r"\b(θερμοκρασ[ιί]α|βαθμ[οό]υ?ς?)\b", 0.85),
        (r"\b(ηλι[οό]ς?|ήλι[οό]ς?|συννεφ)\b", 0.85),
        (r"\b(ομπρελα|ομπρέλα)\b", 0.9),
        (r"\b(τι\s+καιρο|τί\s+καιρό)\b", 0.95),
    )),
    ("news", (
        (r"\b(νεα|νέα|ειδησ[εη]ις?|ειδήσ[εη]ις?)\b", 0.9),
        (r"\b(news)\b", 0.85),
        (r"\bτι\s+(γινεται|γίνεται)\s+(στ[ηο]ν?|στην?)\s+(ελλαδα|ελλάδα|κοσμο|κόσμο)\b", 0.9),
        (r"\b(τι\s+γινεται|τί\s+γίνεται)\s+(σημερα|σήμερα)\b", 0.8),
        (r"\b(πολιτικ[αάηή]|οικονομι[αά]|αθλητικ[αά])\b", 0.75),
        (r"\b(tech\s*news|τεχνολογ[ιί]α\s+νεα)\b", 0.85),
        (r"\b(τι\s+εγινε|τί\s+έγινε)\s+(στ[ηο]ν?|με\s+τ)\b", 0.75),
    )),
    ("personal", (
        (r"\b(ποιος|ποια)\s+(εισαι|είσαι)\b", 0.95),
        (r"\bπως\s+(σε\s+)?λενε\b", 0.95),
        (r"\bπώς\s+(σε\s+)?λένε\b", 0.95),
        (r"\b(ποσο|πόσο)\s+(χρονων|χρονών)\b", 0.95),
        (r"\bηλικια\b", 0.9),
        (r"\bηλικία\b", 0.9),
        (r"\b(απο\s+που|από\s+πού)\s+(εισαι|είσαι)\b", 0.95),
        (r"\bγεννη(θηκες|θήκες)\b", 0.9),
        (r"\b(τι|τί)\s+(δουλεια|δουλειά)\s+(κανεις|κάνεις)\b", 0.95),
        (r"\bπου\s+(δουλευεις|δουλεύεις)\b", 0.95),
        (r"\b(τι|τί)\s+(σπουδ(ασες|ασεις|αζεις)|σπούδ(ασες|ασεις|άζεις))\b", 0.9),
        (r"\bπτυχιο\b", 0.85),
        (r"\bπτυχίο\b", 0.85),
        (r"\bμεταπτυχιακ[οό]\b", 0.9),
        (r"\bδιπλωματικ[ηή]\b", 0.9),
        (r"\bστρατ[οό]\b", 0.8),
        (r"\bhobb(y|ies)\b", 0.85),
        (r"\bχομπ[ιυ]\b", 0.85),
        (r"\bβιογραφικ[οό]\b", 0.85),
        (r"\b(cv|resume)\b", 0.85),
        (r"\bπες\s+μου\s+για\s+(σενα|εσένα|τον εαυτο σου)\b", 0.9),
        (r"\bπες\s+μου\s+για\s+(σένα|εσένα|τον εαυτό σου)\b", 0.9),
        (r"\bγιατ[ιί]\s+(διαλεξες|διάλεξες|επελεξες|επέλεξες)\b", 0.85),
        (r"\b(τι|τί)\s+(τεχνολογ|εργαλει|εργαλεί)\w*", 0.8),
        (r"\bπ[ωώ]ς\s+(το\s+)?(υλοποιησες|υλοποίησες|εφτιαξες|έφτιαξες|εχτισες|έχτισες)\b", 0.85),
        (r"\bπ[ωώ]ς\s+αντιμετ[ωώ]πισες\b", 0.85),
        (r"\b(ποια|ποιο)\s+(ηταν|ήταν)\s+(η|το)\s+(μεγαλυτερη|μεγαλύτερη|κυρια|κύρια|βασικ[ηό])\b", 0.8),
        (r"\b(δυσκολ|προκλησ|πρόκλησ)\w*\s+(που|στην|στη)\b", 0.7),
        (r"\b(αρχιτεκτονικ|μεθοδολογ)\w*", 0.8),
        (r"\b(συνεισφορ|συμπερασμ|συμπέρασμ)\w*", 0.75),
        (r"\b(μελλοντικ[ηή]|επομεν[αο]|επόμεν[αο])\s+(εργασ|βημα|βήμα)\w*", 0.75),
        (r"\bπεριορισμ(ο[ιί]|ούς|ους)\b", 0.8),
        (r"\b(krikri|κρικρι|qlora|lora|rag|ollama|databricks|ray)\b", 0.75),
        (r"\b(ποιο|ποια|τι|τί)\s+(μοντ[εέ]λο|dataset|corpus|δεδομ[εέ]να)\b", 0.85),
        (r"\bπ[ωώ]ς\s+(εγινε|έγινε)\s+(η\s+)?(εκπαιδευ|εκπαίδευ|αξιολογ|αξιολόγ)\w*", 0.85),
        (r"\bπο[υύ]\s+(τρεχει|τρέχει|εκπαιδευ\w*)\b", 0.8),
        (r"\bfine[- ]?tun\w*", 0.75),
        (r"\b(gdpr|ανωνυμοποι)\w*", 0.8),
    )),
    ("knowledge", (
        (r"\bθυμ(ασαι|άσαι|ηθηκες|ήθηκες)\b", 0.85),
        (r"\b(τι|τί)\s+(μου\s+)?(ελεγες|έλεγες|ειπες|είπες)\b", 0.85),
        (r"\b(τι|τί)\s+(ειχες|είχες)\s+(πει|γραψει|γράψει)\b", 0.85),
        (r"\b(τι|τί)\s+(συζητησαμε|συζητήσαμε|λεγαμε|λέγαμε)\b", 0.85),
        (r"\b(ειχαμε|είχαμε)\s+(πει|συζητησει|συζητήσει|μιλησει|μιλήσει)\b", 0.85),
        (r"\bπαλι[οό]τερα\b", 0.65),
        (r"\b(τι|τί)\s+(εγινε|έγινε)\s+με\s+", 0.75),
        (r"\b(εκεινο|εκείνο|εκεινη|εκείνη)\s+το\s+θεμα\b", 0.75),
        (r"\bγια\s+(εκεινο|εκείνο)\s+που\b", 0.7),
    )),
    ("casual", (
        (r"\b(πως|πώς)\s+(να|θα)\b", 0.7),
        (r"\b(εξηγησε|εξήγησε)\b", 0.75),
        (r"\b(τι\s+ειναι|τί\s+είναι)\s+\w+", 0.7),
        (r"\bβοηθ(εια|ησε|ήσε)\b", 0.65),
        (r"\bπροβλημα\b", 0.7),
        (r"\bπρόβλημα\b", 0.7),
        (r"\b(error|bug|crash|fix)\b", 0.75),
        (r"\bδεν\s+(δουλευει|δουλεύει|λειτουργ)\b", 0.75),
        (r"\b(internet|ιντερνετ|ίντερνετ|wifi|router)\b", 0.7),
        (r"\b(κωδικ[οό]|password)\b", 0.65),
        (r"\bτεχνικ[οόηή]\b", 0.65),
    )),
    ("casual", (
        (r"^(γεια|γειά|γεια\s+σου|γειά\s+σου|hey|hi|hello)\b", 0.9),
        (r"^(καλημερα|καλημέρα|καλησπερα|καλησπέρα|καληνυχτα|καληνύχτα)\b", 0.9),
        (r"\b(τι\s+κανεις|τί\s+κάνεις|τι\s+κάνεις|τι\s+λεει|τί\s+λέει)\b", 0.85),
        (r"\b(τι\s+γινεται|τί\s+γίνεται|τι\s+γίνεται)\b", 0.85),
        (r"\b(παμε|πάμε)\s+(για|να)\s+(καφε|καφέ|μπυρα|μπύρα|φαγητο|φαγητό)\b", 0.85),
        (r"\b(ευχαριστω|ευχαριστώ|thanks|thank you)\b", 0.8),
        (r"\b(οκ|οκει|ωραια|ωραία|εντάξει|ενταξει)\b", 0.75),
        (r"^(ναι|όχι|οχι)[\s!.]*$", 0.8),
        (r"\b(χαχα|lol|haha|xaxa)\b", 0.85),
    )),
)

#: Shapes of questions that call for facts (over folded text).
TECHNICAL_QUESTIONS = (
    r"τεχνολογ",
    r"εργαλει",
    r"framework|βιβλιοθηκ",
    r"γλωσσ\w*\s+προγραμ|προγραμματισμ",
    r"στοιβα|stack\b",
    r"διπλωματικ|πτυχιακ|εργασια\s+σου|thesis",
    r"μοντελ\w*\s|\bmodel\b|krikri|llama|qlora|lora\b",
    r"εκπαιδευ|training|fine.?tun",
    r"αρχιτεκτονικ|υλοποιησ|implementation",
    r"δουλεψ\w*\s+(?:με|φετος|πανω)|ασχοληθηκ|χρησιμοποι",
    r"τι\s+εκανες\s+(?:φετος|στη|στο|για)",
    r"πως\s+(?:το\s+)?(?:εφτιαξ|υλοποιησ|εκανες|δουλευει)",
    r"γιατι\s+(?:διαλεξ|επελεξ)",
)

#: Acronyms and the wordings by which a gloss is right.
ACRONYMS = {
    "PEFT": ("parameter-efficient", "parameter efficient"),
    "TRL": ("transformer reinforcement",),
    "QLoRA": ("quantized low-rank", "quantized low rank"),
    "LoRA": ("low-rank", "low rank"),
    "RAG": ("retrieval-augmented", "retrieval augmented"),
    "NF4": ("normalfloat", "normal float"),
    "BM25": ("best matching",),
    "RRF": ("reciprocal rank",),
}

#: Other writings of technology names.
TECH_ALIASES = {"krikri": "llama", "chromadb": "chroma", "delta lake": "deltalake", "postgresql": "postgres", "kubernetes": "k8s"}
