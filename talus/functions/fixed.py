"""Word lists, tables and patterns that results depend on, in Spanish as the corpus is."""

# --- fixed values -------------------------------------------------------------------------------
#: Letters with marks and what is left without them; ß has no mark and stays.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

VALID_TYPES = ["FB", "OB", "OP", "OB-IS", "OB-SI", "OB-TI", "TFG"]
TYPE_SYNONYMS = {"formación básica": "FB", "obligatoria": "OB", "optativa": "OP", "obl": "OB"}
TYPE_LABELS = {
    "FB": "asignatura de formación básica",
    "OB": "asignatura obligatoria",
    "OP": "asignatura optativa",
    "OB-IS": "asignatura obligatoria de la especialidad Ingeniería del Software",
    "OB-SI": "asignatura obligatoria de la especialidad Sistemas de Información",
    "OB-TI": "asignatura obligatoria de la especialidad Tecnologías de la Información",
    "TFG": "Trabajo Fin de Grado",
}
YEAR_ORDER = ["primer", "segundo", "tercer", "cuarto", "quinto", "sexto"]
COMMON_MENTION = "comun a todas las menciones"

STOPWORDS = (
    "a al algo cual cuales cuando de del donde el ella ellas ello ellos en esa esas ese eso esos esta estas este esto "
    "estos hay la las le les lo los me mi mis o para pero por que se ser son su sus tambien te tiene tienen tu un una "
    "unas uno unos y ya"
).split()
ORDINALS = "primer primero primera segundo segunda tercer tercero tercera cuarto cuarta quinto quinta ultimo ultima".split()
PLURAL_DEMONSTRATIVES = ["estas", "estos", "esas", "esos"]
ANAPHORA = ["de esas", "de esos", "de estas", "de estos", "de ellas", "de ellos", "de las anteriores", "de los anteriores"]

COURTESY = (
    "hola holaa wenas buenas buenos buen dia dias tardes noches saludos saludo hello hi hallo hey ey que q k ke qtal tal "
    "como estas esta estais andas pasa va vas tu ti te usted muy bien gracias muchas mil adios chao hasta luego pronto "
    "manana vale ok nada por favor un una y de a eres quien todo"
).split()
GREETING = "hola holaa wenas qtal buenas buenos saludos hey ey hello hi hallo".split()
GREETING_PAIRS = [
    ["que", "tal"], ["q", "tal"], ["k", "tal"], ["ke", "tal"], ["que", "pasa"], ["como", "estas"], ["como", "estais"],
    ["como", "usted"], ["como", "va"], ["como", "vas"], ["como", "andas"], ["buen", "dia"],
]
FAREWELL = "gracias adios chao hasta luego pronto".split()
INTERROGATIVES = (
    "que cual cuales cuando cuanto cuanta cuantos cuantas como donde quien quienes dime cuentame hablame explicame "
    "ensename recomiendame dame damelo muestrame ponme escribeme buscame ayudame necesito quiero busco escribe haz dale "
    "informacion info"
).split()
ADVICE = (
    "recomiendas recomiendame recomienda recomendacion recomendarias recomendable aconsejas aconsejarias gusta gustan "
    "gustaria encanta interesa interesan encaja encajan elegir elijo escoger escojo orientacion vocacion dudo decidir"
).split()
ADVICE_PHRASES = ["no se que estudiar", "no se que carrera", "no tengo claro", "que estudio", "que carrera", "se me da bien", "se me dan bien"]
QUOTED = "«[^»]*»|\"[^\"]*\"|“[^”]*”|'[^']{4,}'"
DOMAIN_SENTENCE = "Titulaciones, grados y dobles grados de la Escuela Politécnica Superior de Jaén, sus asignaturas y sus salidas profesionales."
OWN_PLACES = ["jaen", "lagunillas"]
#: A centre of studies in normalised text; what it captures is its place.
CENTRE = "(?:universidad|universitat|escuela|facultad|campus)(?: +[a-z]+){0,3}? +(?:de +(?:la|las|los|el)|del|de) +([a-z]+)"
ABBREVIATIONS = {"ing.": "ingenieria"}
NO_CREDITS_LISTED, NO_CREDITS_SAID, NO_YEAR_SAID = " (créditos no publicados)", ". La web de la EPSJ no publica sus créditos", ", sin curso asignado en el plan"
NOT_OFFERED_SAID = ". No ofertada en el curso rastreado"
PLAN_WORDS = ["creditos", "credito", "ects", "curso", "cuatrimestre", "semestre"]
CATALOGUE_HEADING = "TITULACIONES DE LA ESCUELA. Son estas y no hay ninguna más:"
ONE_SCOPE = "ÁMBITO: la consulta es sobre el "
SCOPES_HEADING = "ÁMBITO: la consulta abarca estas titulaciones:"
EARLIER_HEADING = "PREGUNTAS ANTERIORES DEL ESTUDIANTE:"
NO_CONTEXT = "(no se ha recuperado ningún fragmento)"

SECTION_SUMMARY, SECTION_CONTENTS = "RESUMEN", "DESCRIPCIÓN DE CONTENIDOS"
SECTION_LABELS = [
    "FICHA IDENTIFICATIVA", "PROFESORADO", "RESUMEN", "COMPETENCIAS / RESULTADOS DEL PROCESO DE FORMACIÓN Y APRENDIZAJE",
    "DESCRIPCIÓN DE CONTENIDOS", "METODOLOGÍAS DOCENTES Y ACTIVIDADES FORMATIVAS", "SISTEMAS DE EVALUACIÓN", "BIBLIOGRAFÍA",
    "OBJETIVOS DE DESARROLLO SOSTENIBLE", "ESTUDIANTADO CON NECESIDADES ESPECÍFICAS DE APOYO EDUCATIVO", "PLAN DE CONTINGENCIA",
    "CLÁUSULAS", "COMPROMISO CON LA IGUALDAD Y LA PERSPECTIVA DE GÉNERO",
    "COMPETENCIAS", "RESULTADOS DE APRENDIZAJE", "METODOLOGÍA DOCENTE", "SISTEMA DE EVALUACIÓN",
]
PAGE_NOISE = ["^Página +[0-9]+ +de +[0-9]+$", "^Guía Docente$", "^[0-9]{8} +- +", "^Curso Académico"]

#: Headings in normalised text: the term, and the year or two years of which a plan leaves the choice open.
TERM_SAID = r"\b(primer|segundo) cuatrimestre\b"
YEAR_SAID = r"\b((?:primer[o]?|segundo|tercer[o]?|cuarto|quinto|sexto)(?: o (?:primer[o]?|segundo|tercer[o]?|cuarto|quinto|sexto))?) curso\b"
ELECTIVE_SAID = "optativ"
DEGREE_WORD, DOUBLE_DEGREE, ENDING_DEGREE = "Grado", "Doble Grado", "en extincion"
MENU_PATH = "aside.layout-sidebar-first nav ul.menu li a"
SUBJECTS_LINKS, CAREERS_LINK = ["asignaturas-y-profesorado", "plan-de-estudios"], "salidas-profesionales"
SHEET, SUMMARY_ID, CONTENTS_ID, VALUE_CLASS = "#fichadocenteasignatura", "resumen", "descripcioncontenidos", "fdoca_valor_cuadro_ambito"
LEFT_OUT_IDS = ["coordinador", "equipodocente", "clausulas", "objetivosdesarrollosostenible"]
LEAST_GUIDE = 200

PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "
CHUNK_MAX, CHUNK_MIN = 900, 200
K_DEFAULT, K_LEAST, K_MOST, CUT_FACTOR, FLOOR = 10, 3, 20, 1.20, 0.137
REMEMBERED = 3
#: Words that deny, in normalised text.
NEGATIONS = "no ninguna ninguno ningun nada tampoco nunca ni".split()
#: Thresholds of a vector store: milliseconds of the median, MiB of memory.
LATENCY_MS, MEMORY_MB = 500, (512, 1024)
Z95 = 1.959963984540054
# --- end of fixed values -------------------------------------------------------------------------
