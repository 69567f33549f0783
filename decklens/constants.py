"""Thresholds, weights, labels, word lists, patterns and messages.

The results are defined by these values; nothing here is logic.
"""

from __future__ import annotations

# --- character classes (Java regex, used inside [...]) --------------------------------------
#
# Members below U+0100 are listed one by one: Java then tests them with one table look-up, while
# each range costs a call. The few members above stand behind an outer range for the same reason.

# Every character for which Python's str.isspace() is true. Java's \s is ASCII-only without (?U),
# and (?U) misses U+001C..U+001F.
WS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
# Letters of Spanish words, both cases.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZáéíóúüñÁÉÍÓÚÜÑ"
# The same class as a case-insensitive Unicode match sees it: dotted capital I, dotless i, long s
# and the Kelvin sign fold into the ASCII letters.
LETTERS_FOLDED = LETTERS + r"[\u0130-\u212a&&[\u0130\u0131\u017f\u212a]]"
VOWELS = "aeiouáéíóúüAEIOUÁÉÍÓÚÜ"
WEAK_VOWELS = "iuüíúIUÜÍÚ"
STRONG_VOWELS = "aeoáéóAEOÁÉÓ"
CONSONANTS = "bcdfghjklmnpqrstvwxyzñBCDFGHJKLMNPQRSTVWXYZÑ"
CONSONANTS_BUT_Y = "bcdfghjklmnpqrstvwxzñBCDFGHJKLMNPQRSTVWXZÑ"

# --- extraction ------------------------------------------------------------------------------

SIZE_LIMIT_MB = 30
TITLE_MAX_WORDS = 25
TITLE_MAX_CHARS = 180
TITLE_ZONE_BELOW = 0.25
FOOTER_ZONE_FROM = 0.75
FOOTER_LOW_FROM = 0.85
FOOTER_LOW_WORDS = 25
FOOTER_SHORT_WORDS = 6
FOOTER_META_WORDS = 15
NUMBER_ZONE_ABOVE = 0.05
NUMBER_ZONE_BELOW = 0.90
IMAGE_SHAPE_TYPES = ("PICTURE", "TABLE")

# Words that mark a low text block as metadata of the course (matched without case).
FOOTER_COURSE_WORDS = (
    "materia|asignatura|unidad|semestre|grupo|docente|profesor|instituto|tecnol[oó]gico|"
    "universidad|facultad"
)
FOOTER_MONTHS = (
    "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
)

# --- complexity index and word load ------------------------------------------------------------

READABILITY_MIN_WORDS = 5
DENSITY_MIN_TOKENS = 5
ICD_MIN_WORDS = 15
FSZ_BASE = 206.835
FSZ_SYLLABLE_FACTOR = 62.3
ICD_WEIGHT_READABILITY = 0.6
ICD_WEIGHT_DENSITY = 0.4
SENTENCE_MAX_WORDS = 20
WPS_OPTIMUM = 50
WPS_DENSE_UP_TO = 70
WPS_WORDS_PER_POINT = 15

# (lower limit, label), first match wins; below all of them: "arido".
FSZ_ZONES = ((80, "muy facil"), (65, "facil"), (50, "normal"), (35, "dificil"), (15, "muy dificil"))
FSZ_ZONE_REST = "arido"
# (upper limit, label), first match wins.
ICD_ZONES = ((2.0, "muy simple"), (3.5, "simple"), (6.5, "apropiado"), (8.0, "complejo"))
ICD_ZONE_REST = "muy complejo"
SCORE_ZONES = ((4.0, "deficiente"), (6.0, "regular"), (8.0, "bueno"))
SCORE_ZONE_REST = "excelente"
ICD_LOW, ICD_HIGH = 3.5, 6.5
ICD_PENALTY = 5.0

# --- scores --------------------------------------------------------------------------------------

WEIGHTS = {"icd": 0.30, "wps": 0.30, "hss": 0.25, "nts": 0.15}
HSS_GOOD_ABOVE = 7.0
NTS_GOOD_ABOVE = 5.0
HSS_DEFAULT = 5.0
NTS_DEFAULT = 10.0
SECONDS_DEFAULT = 10
VISUAL_BELOW_WORDS = 15
EMPTY_BELOW_WORDS = 5
HSS_LABELS = ((8.0, "coherente"), (5.0, "debil"))
HSS_LABEL_REST = "no_coherente"
NTS_LABELS = ((7.0, "relacionada"), (4.0, "debil"))
NTS_LABEL_REST = "desconectada"
NOT_APPLICABLE = "no_aplica"

# --- judge exchange ------------------------------------------------------------------------------

NO_TITLE = "[SIN TÍTULO]"
NO_OVERLAP = "Ninguno"
PAYLOAD_CHARS = 400
RESTRUCTURE_CHARS = 1500
SPEAKING_WORDS_PER_MINUTE = 130
EXPLAINING_MARGIN = 1.20
GENERATED_WORDS = (30, 50)
GENERATED_SENTENCES = (3, 4)
GENERATED_SENTENCE_WORDS = 15
GENERATED_TITLE_WORDS = (3, 8)
FORBIDDEN_TERMS = (
    "pedagogía", "pedagógico", "didáctico", "optimiza", "optimización",
    "aprendizaje significativo", "facilita el aprendizaje", "mejora la comprensión",
    "ayuda a los estudiantes", "para una mejor enseñanza", "enriquece el conocimiento",
)

# --- classifier ----------------------------------------------------------------------------------

EXCLUDED_TYPES = ("portada", "indice", "referencias", "cierre", "visual", "cita", "sin_contenido")
JUDGED_TYPES = ("portada", "indice", "referencias", "contenido", "cierre", "cita")
CONFIDENCE_MEDIUM = 0.60
CONFIDENCE_JUDGED = 0.70
CONFIDENCE_FALLBACK = 0.50
USEFUL_MIN_WORDS = 15
TITLE_WORDS = {
    "portada": "portada|presentaci[oó]n|bienvenid[oa]s?",
    "indice": "[íi]ndice|temario|agenda",
    "referencias": "referencias?|bibliograf[íi]a|fuentes?|webgraf[íi]a|recursos",
    "cierre": "gracias|conclusiones?|cierre|fin|preguntas?|dudas?",
}

# --- class time -----------------------------------------------------------------------------------

DEVIATION_LIMIT = 20
ALERT_LIMIT = 15
TOP_DEVIATIONS = 3
GROUP_MAX_CHARS = 5
PLAN_MAX_MINUTES = 90

# --- word lists (fixed values) ------------------------------------------------------------------------

# Function words for the lexical density and the longest-word examples. (Phrases of several words
# are left out: they can never equal one token.)
DENSITY_STOP_WORDS = tuple("""
el la los las un una unos unas
a ante bajo con contra de desde durante en entre
hacia hasta mediante para por según sin sobre tras
versus vía
y e ni o u pero sino aunque porque pues que
si como cuando donde mientras ya además también
así
yo tú él ella nosotros vosotros ellos ellas
me te se nos os le les lo
mi tu su nuestro vuestra nuestros sus
quien quienes cual cuales cuyo cuya
qué quién cómo cuándo dónde cuánto
es son era eran fue fueron ser estar estoy estás
está estamos están estaba estaban hay haber ha han
había hubiera tiene tienen tenía tener puede pueden
podía poder debe deben debía deber hace hacen hacer
este esta estos estas ese esa esos esas
aquel aquella aquellos aquellas mucho muchos poco pocos
todo todos toda todas otro otros otra otras
más menos muy bien mal tan tanto cuanto
no sí tampoco nunca jamás siempre aún todavía
al del
embargo entonces luego
después antes finalmente primero segundo tercero
""".split())

# Stop words of the title keywords.
TITLE_STOP_WORDS = tuple("""
el la los las un una unos unas a ante bajo con contra
de desde en entre hacia hasta para por según sin sobre
tras y e ni o u pero sino aunque porque que si como
cuando donde mientras ya también además este esta estos
estas ese esa esos esas aquel aquella aquellos aquellas
yo tú él ella nosotros ellos me te se nos es son
""".split())

# Generic academic words that never count as title keywords.
ACADEMIC_FILLER = tuple("""
ejemplo caso importante definicion concepto introduccion
conclusion tema unidad capitulo objetivo descripcion
analisis nota resumen fundamentos presentacion
""".split())

# Stop words of the narrative term vectors.
NARRATIVE_STOP_WORDS = tuple("""
el la los las un una unos unas a ante bajo con contra
de desde en entre hacia hasta para por según sin sobre
tras y e ni o u pero sino aunque porque que si como
cuando donde mientras ya también además yo tú él ella
nosotros ellos me te se nos es son era fue ser estar
""".split())

# --- messages shown to the author -------------------------------------------------------------------

ICD_HIGH_MESSAGE = (
    "El nivel de complejidad es alto (ICD: ",
    "). Esto se debe principalmente a la falta de conectores o al uso de términos muy extensos",
    " (por ejemplo: '",
    "')",
    ". Se sugiere simplificar la redacción utilizando sinónimos más accesibles o dividiendo las "
    "oraciones, cuidando de no perder el concepto académico original.",
)
ICD_LOW_MESSAGE = (
    "El lenguaje utilizado es demasiado básico para el nivel superior (ICD: ",
    "). Se sugiere incorporar terminología académica o técnica apropiada para enriquecer el "
    "aprendizaje.",
)
WPS_MESSAGE = (
    "Se ha detectado un exceso de contenido (",
    " palabras de más). Se sugiere reestructurar el texto o dividir las ideas principales en "
    "múltiples diapositivas para mantener un máximo de 50 palabras (sin contar el título), "
    "optimizando así la retención del estudiante.",
)
SIZE_MESSAGE = ("El archivo es demasiado pesado (", "MB). El límite es ", "MB.")
SPLIT_MESSAGE = ("Se recomienda dividir la diapositiva en ", " diapositivas:")
REWRITE_MESSAGE = "Se recomienda redactar el contenido de la siguiente manera:"
STATUS_UNDER = "Poco tiempo"
STATUS_OVER = "Excedió tiempo"
STATUS_OK = "En rango"
STATUS_NO_TIME = "Sin tiempo real"
ALERT_UNDER = "Mayor déficit de tiempo en este grupo"
ALERT_OVER = "Mayor exceso de tiempo en este grupo"
