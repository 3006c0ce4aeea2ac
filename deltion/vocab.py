"""The domain vocabulary the classifiers use, as plain text in natural order.

Terms are folded before use (`functions.text.fold_term`), so accents and final sigma do not matter.
"""

# Stems that speak for public works.
PUBLIC_WORKS = [
    "εργο", "εργασι", "οδοποι", "οδικ", "οδος", "οδων", "ασφαλτο", "ασφαλ", "αναπλα", "κατασκευ", "επισκευ",
    "συντηρη", "αποκαταστα", "τεχνικ", "διαμορφω", "αναβαθμ", "κτιρι", "κτηρι", "σχολει", "γηπεδ", "πεζοδρομ",
    "λιμενικ", "αντιπλημμυρ", "υποδομ", "πυρασφαλ", "δακ",
]
# The works stems that are too general to outweigh a supply term.
NOT_INFRASTRUCTURE = ["ασφαλ", "τεχνικ"]
# Tender wording.
TENDER = [
    "διακηρυ", "προκηρυ", "διαγωνισ", "προσκληση", "υποβολη προσφορ", "δημοσια συμβασ", "τευχ", "προυπολογισ",
    "μελετη", "αναθεση",
]
# Administrative wording.
ADMIN_DROP = [
    "κανονισμος λειτουργιας", "αποφαση γενικου διευθυντη", "ανακοινωση σοχ", "προσληψη προσωπικου",
    "προγραμμα εκλογων", "εντολη μισθωσης", "νεος προεδρος", "συνεδριαση", "εκτος εδρας", "ορισμος αντιδημαρχ",
    "παραχωρηση χρησης",
]
# Supply and service wording.
SUPPLY_DROP = [
    "εκπαιδευση", "εξομοιωτ", "flight simulator", "κλιβανος", "αποστειρωση", "πλυντηριο χειρουργικ", "τροφ",
    "φαρμακ", "οχηματων", "προμηθεια ειδων",
]

# Document types by wording of the file name, first match wins.
DOCUMENT_RULES = [
    ("technical_description", ["τεχνικη περιγραφη", "τεχνική περιγραφή"]),
    ("tender_declaration", ["διακηρυξη", "διακήρυξη"]),
    ("budget", ["προυπολογισμος", "προϋπολογισμος", "προϋπολογισμός"]),
    ("price_list", ["τιμολογιο μελετης", "τιμολόγιο μελέτης", "τιμολογιο"]),
    ("special_conditions", ["εσυ", "ειδικη συγγραφη", "ειδική συγγραφή"]),
    ("financial_offer_form", ["οικονομικη προσφορα", "οικονομική προσφορά"]),
    ("espd", ["espd", "εεεσ"]),
]

# Acts that change the status of a procedure, by wording of the file name.
ACT_PATTERNS = [
    ("extension", ["παραταση", "παράταση", "μεταθεση", "μετάθεση"]),
    ("amendment", ["τροποποιηση", "τροποποίηση"]),
    ("correction", ["ορθη επαναληψη", "ορθή επανάληψη", "διορθωση", "διόρθωση"]),
    ("cancellation", ["ματαίωση", "ματαιωση", "ακύρωση", "ακυρωση"]),
    ("participation_table", ["πινακας συμμετεχοντων", "πίνακας συμμετεχόντων"]),
    ("evaluation_minutes", ["πρακτικο", "πρακτικό", "αποσφραγιση", "αποσφράγιση", "αξιολογηση", "αξιολόγηση"]),
    ("provisional_award", ["προσωρινος αναδοχος", "προσωρινός ανάδοχος", "μειοδοτης", "μειοδότης"]),
    ("final_award", ["κατακυρωση", "κατακύρωση"]),
    ("contract", ["συμβαση", "σύμβαση"]),
]
# Phrases in a declaration's text that only mention a procedure step.
PROCEDURAL_PHRASES = ["κατακύρωση", "αποσφράγιση", "σύμβαση"]

# Wording of road maintenance works, and wording that rules them out.
ROAD = [
    "οδικου δικτυου", "επαρχιακου δικτυου", "οδικο δικτυο", "επαρχιακο δικτυο", "οδοποι", "οδων", "ασφαλτοστρω",
    "αποχιον", "χιονο",
]
ROAD_MAINTENANCE = ["συντηρη", "επισκευ", "αποκαταστα", "βελτιω"]
ROAD_TENDER = ["διαγωνισ", "διακηρυ", "υποβολη", "προσφορ", "προθεσμι", "deadline"]
ROAD_EXCLUDED = [
    "απευθειας αναθεση", "απευθειας αναθεσης", "αρθρο 118", "αρ. 118", "οχι ανοιχτος διαγωνισμος",
    "οχι ανοικτος διαγωνισμος", "συμβαση", "υπογεγραμμενη συμβαση",
]
# The narrower road wording used when reviewing hidden rows.
REVIEW_ROAD = ["οδικου δικτυου", "οδικο δικτυο", "επαρχιακου δικτυου", "επαρχιακο δικτυο", "οδοποι", "οδων"]
REVIEW_MAINTENANCE = ["συντηρη", "επισκευ", "αποκαταστα", "βελτιω", "αποχιον", "χιονο"]
REVIEW_TENDER = ["διαγωνισ", "διακηρυ", "προσφορ", "αναδοχ"]
# Title wording that is plainly out of scope, with the reason shown.
OUT_OF_SCOPE = [
    ("προμήθεια καυσίμων/λιπαντικών, όχι δημόσιο έργο κατασκευής", ["καυσιμ", "λιπαντικ"]),
    ("μεταφορά μαθητών, δηλαδή υπηρεσία μεταφοράς εκτός δημοσίων έργων", ["μεταφορα μαθητ", "μεταφορασ μαθητ"]),
    (
        "προμήθεια/εγκατάσταση συστήματος τηλεελέγχου ή τηλεχειρισμού, όχι κατασκευαστικό δημόσιο έργο",
        ["τηλεελεγχ", "τηλεχειρισ", "συστημα τηλε", "συστηματος τηλε"],
    ),
]
# Signals looked for in hidden rows.
REVIEW_WORKS_SIGNAL = [
    "εργο", "εργασι", "οδικ", "οδοποι", "συντηρη", "ασφαλτο", "κατασκευ", "επισκευ", "αποκαταστα", "διαγωνισ",
    "διακηρυ", "προυπολογισ",
]
REVIEW_TENDER_SIGNAL = ["διαγωνισ", "διακηρυ", "υποβολη", "προσφορ", "προθεσμι"]

# Labels a row can carry; those that keep it for review.
DECISIONS = [
    "KEEP_ACTIVE_TENDER", "REVIEW_TENDER_CANDIDATE", "EARLY_SIGNAL", "DROP_ADMIN",
    "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE", "DROP_NOT_PUBLIC_WORKS",
]
KEEP_DECISIONS = ["KEEP_ACTIVE_TENDER", "REVIEW_TENDER_CANDIDATE"]
HIDDEN_CATEGORY = {
    "DROP_ADMIN": "AI_DROP_ADMIN",
    "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE": "AI_DROP_SUPPLY_SERVICE",
    "DROP_NOT_PUBLIC_WORKS": "AI_DROP_NOT_PUBLIC_WORKS",
    "EARLY_SIGNAL": "AI_EARLY_SIGNAL",
}
HIDDEN_LABEL = {
    "DROP_ADMIN": "διοικητική/μη διαγωνιστική πράξη",
    "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE": "προμήθεια ή υπηρεσία εκτός δημοσίων έργων",
    "DROP_NOT_PUBLIC_WORKS": "όχι δημόσιο έργο κατασκευής",
    "EARLY_SIGNAL": "πρώιμο σήμα, όχι ενεργός διαγωνισμός",
}

# Units a budget line can be measured in.
UNITS = [
    "m", "m2", "m3", "μ2", "μ3", "kg", "kgr", "tn", "ton", "t", "tkm", "ton.k", "tonx1", "tonx10m", "ημ/σ", "τεμ",
    "τεμ.", "tem", "τεμαχ", "τεμαχι", "τεμαχιο", "τ.μ", "τ.μ.", "μ", "μ.μ", "μ.μ.", "mm", "μμ", "κ.α", "κ.α.",
    "m*cm", "dm2", "στρ", "h", "km", "lt",
]

# Notice families of the procurement feed: source, record type, endpoint.
NOTICE_FAMILIES = [
    ("khmdhs_notice", "PROC", "notice"),
    ("khmdhs_auction", "AWRD", "auction"),
    ("khmdhs_contract", "SYMV", "contract"),
]
FEED_URL = "https://cerpp.eprocurement.gov.gr/khmdhs-opendata/"
# Act families of a connected-acts chain in reading order; endpoint by id prefix.
ACT_FAMILIES = ["notices", "requests", "approvedRequests", "auctions", "contracts", "payments"]
ACT_ENDPOINTS = {"26REQ": "request", "26PROC": "notice", "26AWRD": "auction", "26SYMV": "contract", "26PAY": "payment"}
DOCUMENT_EXTENSIONS = ["pdf", "zip", "doc", "docx", "xls", "xlsx", "xml"]


def _category(cid, label, polarity, weight, cpv, strong, medium):
    return {"id": cid, "label": label, "polarity": polarity, "weight": weight, "cpv": cpv, "strong": strong, "medium": medium}


# Project categories with their signals.
TAXONOMY = [
    _category("road_works", "Οδοποιία / οδικά έργα", "positive", 2, ["45233"],
              ["οδοποιία", "οδικό δίκτυο", "επαρχιακή οδός", "επαρχιακού οδικού", "ασφαλτόστρωση", "τσιμεντόστρωση",
               "ανακατασκευή οδών", "εργασίες συντήρησης οδών"],
              ["σήμανση", "βατότητα", "μικροβλάβες", "τεχνικά έργα", "διαβάσεις", "πρανή", "οδοί"]),
    _category("building_works", "Κτιριακά έργα", "positive", 2, ["4521", "4526", "454"],
              ["κτίριο", "σχολείο", "γυμνάσιο", "προσθήκη ορόφου", "στέγαστρο", "βρεφονηπιακός σταθμός", "δημαρχείο",
               "νοσοκομείο"],
              ["στέγη", "ψευδοροφή", "επισκευή κτιρίου", "σχολικές μονάδες"]),
    _category("sports_facilities", "Αθλητικές εγκαταστάσεις", "positive", 2, [],
              ["γήπεδο", "δακ", "αθλητικές εγκαταστάσεις", "beach volley", "κλειστό γυμναστήριο"],
              ["αθλητισμού", "συντήρηση γηπέδων"]),
    _category("energy_upgrade", "Η/Μ και ενεργειακή αναβάθμιση", "positive", 2, ["453", "71314"],
              ["ενεργειακή αναβάθμιση", "εξοικονόμηση ενέργειας", "ηλεκτρομηχανολογικές εγκαταστάσεις",
               "η/μ εγκαταστάσεις"],
              ["ηλεκτροφωτισμός", "φωτισμός", "ενεργειακή διαχείριση"]),
    _category("hydraulic_flood", "Ύδρευση / αποχέτευση / αντιπλημμυρικά", "positive", 2, ["4523", "4524"],
              ["ύδρευση", "αποχέτευση", "αντιπλημμυρικά έργα", "όμβρια", "βιο.κα", "ποταμούς", "χειμάρρους"],
              ["στραγγισ", "δίκτυα ύδρευσης", "δίκτυο ύδρευσης", "αποκατάσταση βλαβών δικτύων"]),
    _category("marine_port", "Λιμενικά έργα", "positive", 2, [],
              ["λιμενική εγκατάσταση", "λιμενικά έργα", "σκάφη", "μαρίνα"], ["λιμένα", "προβλήτα"]),
    _category("public_space", "Αναπλάσεις / κοινόχρηστοι χώροι", "positive", 2, [],
              ["ανάπλαση", "αναπλάσεις", "κοινόχρηστοι χώροι", "χώρος στάθμευσης", "ανοικτό θέατρο"],
              ["παιδική χαρά", "προσβασιμότητα", "παραλίες"]),
    _category("study_consulting", "Μελέτη / τεχνικός σύμβουλος", "negative", 2, [],
              ["εκπόνηση μελέτης", "τεχνικός σύμβουλος", "τεχνικού συμβούλου", "προεκτίμηση αμοιβής"],
              ["μελέτη αναβάθμισης", "επιστημονικού συμβούλου"]),
    _category("supply_service_out", "Προμήθεια ή υπηρεσία εκτός έργων", "negative", 3, [],
              ["προμήθεια καυσίμων", "μεταφορά μαθητών", "υπηρεσίες καθαρισμού", "προμήθεια ανταλλακτικών",
               "προμήθεια υλικών", "προμήθεια εξοπλισμού", "συντήρηση λογισμικού", "μίσθωση μηχανημάτων"],
              ["λιπαντικών", "οχήματα", "φορτωτών", "ελαστικών", "εκτύπωσης"]),
    _category("admin_non_tender", "Διοικητική πράξη / όχι διαγωνισμός", "negative", 3, [],
              ["απόφαση ανάληψης υποχρέωσης", "πρακτικό", "ανακοίνωση σοχ", "χεπ", "προκαταβολή μισθοδοσίας",
               "σύμβαση με"],
              ["έγκριση", "παράταση", "εκπροσώπηση", "προϋπολογισμού εσόδων"]),
    _category("direct_assignment", "Απευθείας ανάθεση / πρόσκληση", "negative", 2, [],
              ["απευθείας ανάθεση", "άρθρο 118", "αρθρου 118", "πρόσκληση οικονομικού φορέα",
               "πρόσκληση εκδήλωσης ενδιαφέροντος"],
              ["έρευνα αγοράς", "διαπραγμάτευση χωρίς δημοσίευση"]),
]
