"""Fixed values that must equal the reference application's for right results.

FIXED VALUES — copied as plain text, in the reference's own order.  Do not
reorder or edit: item codes q01..q30 are positions in ITEMS.
"""

from __future__ import annotations

# --- FIXED VALUES: five-level answer scale (level 1 .. 5) -------------------
LIKERT_LEVELS = [
    "Totalmente en desacuerdo",
    "En desacuerdo",
    "Neutral",
    "De acuerdo",
    "Totalmente de acuerdo",
]

# --- FIXED VALUES: long-header prefix of survey exports ----------------------
LIKERT_PREFIX = ("Indica qué tan identificado te sientes con las siguientes "
                 "afirmaciones cotidianas.")
# anchored, greedy capture between the outer brackets (service and batch form)
LIKERT_PREFIX_PATTERN = (r"^Indica qué tan identificado te sientes con las siguientes "
                         r"afirmaciones cotidianas\.\s*\[(.+)\]\s*$")
# non-greedy first bracket (dashboard label form)
BRACKET_PATTERN = r"\[(.*?)\]"

# --- FIXED VALUES: item dictionary (question, pillar, subdim, reverse, intensity)
ITEMS = [
    ("Mi espacio de trabajo y mi habitación suelen estar siempre ordenados.", "ORDEN", "orden_fisico", False, "media"),
    ("Prefiero terminar mis obligaciones urgentes antes de sentarme a relajarme o salir.", "ORDEN", "disciplina", False, "media"),
    ("Me genera mucha ansiedad la idea de llegar tarde a un compromiso, aunque sea una reunión informal.", "ORDEN", "puntualidad", False, "alta"),
    ("Me molesta profundamente cuando las personas cambian los planes a última hora sin avisar.", "ORDEN", "puntualidad", False, "media"),
    ("Suelo revisar dos o tres veces los mensajes o correos importantes antes de enviarlos.", "ORDEN", "perfeccionismo", False, "baja"),
    ("Cuando empiezo un proyecto personal o tarea en casa, lo termino aunque me tome más tiempo del planeado.", "ORDEN", "disciplina", False, "media"),
    ("Llevo un registro mental o escrito de las tareas que debo hacer durante la semana.", "ORDEN", "orden_fisico", False, "media"),
    ("A menudo dejo las cosas en cualquier lado y luego pierdo tiempo buscándolas.", "ORDEN", "orden_fisico", True, "media"),
    ("Siento que es mi obligación cumplir con una promesa, incluso si la otra persona ya lo olvidó.", "ORDEN", "integridad", False, "alta"),
    ("Frecuentemente postergo tareas aburridas hasta el último minuto posible.", "ORDEN", "disciplina", True, "media"),
    ("A menudo actúo por impulso en el momento y luego me arrepiento de las consecuencias.", "DESCUENTO", "impulsividad", True, "media"),
    ("Prefiero sacrificar mi tiempo libre hoy si sé que eso me traerá un gran beneficio el próximo año.", "DESCUENTO", "persistencia", False, "media"),
    ("Cuando me encuentro con un problema difícil o tedioso, mi primer instinto es abandonarlo y hacer otra cosa.", "DESCUENTO", "persistencia", True, "media"),
    ("Me cuesta mucho resistirme a mis antojos del momento, aunque sepa que después me arrepentiré.", "DESCUENTO", "impulsividad", True, "media"),
    ("Si me dan a elegir, prefiero esperar un mes por una recompensa excelente que recibir una recompensa regular hoy mismo.", "DESCUENTO", "persistencia", False, "media"),
    ("Me aburro rápido de los pasatiempos o proyectos nuevos y salto a otra cosa rápidamente.", "DESCUENTO", "persistencia", True, "media"),
    ("Siempre evalúo los pros y contras antes de tomar una decisión importante en mi vida diaria.", "DESCUENTO", "persistencia", False, "alta"),
    ("Si veo algo que me gusta mucho, busco la forma de tenerlo inmediatamente sin pensar mucho en el futuro.", "DESCUENTO", "impulsividad", True, "media"),
    ("Creo firmemente que mis logros dependen exclusivamente de mi esfuerzo diario y no de la buena suerte.", "LOCUS", "auto_responsabilidad", False, "alta"),
    ("Siento que la mayor parte de las cosas malas que me pasan son culpa de otras personas o de las circunstancias.", "LOCUS", "atribucion_externa", True, "media"),
    ("Si fracaso en un objetivo, analizo qué hice mal para no repetirlo, en lugar de frustrarme con el entorno.", "LOCUS", "auto_responsabilidad", False, "media"),
    ("A veces siento que no tiene sentido planificar demasiado porque el destino ya está escrito.", "LOCUS", "atribucion_externa", True, "media"),
    ("Cuando trabajo en equipo y algo sale mal, asumo mi parte de la culpa en lugar de señalar a los demás de inmediato.", "LOCUS", "auto_responsabilidad", False, "media"),
    ("Confío más en mi propia capacidad para resolver problemas inesperados que en esperar a que alguien más me ayude.", "LOCUS", "auto_responsabilidad", False, "media"),
    ("Siento que el éxito de las personas a mi alrededor se debe más a sus contactos o suerte que a su talento.", "LOCUS", "atribucion_externa", True, "media"),
    ("Jamás he dicho una mentira, ni siquiera una pequeña, para salir de un apuro o evitar un problema.", "MENTIRA", "deseabilidad_social", False, "extrema"),
    ("Nunca he sentido envidia o celos por el éxito de otra persona.", "MENTIRA", "deseabilidad_social", False, "extrema"),
    ("Siempre estoy dispuesto a admitir mis errores de inmediato, sin importar las consecuencias.", "MENTIRA", "deseabilidad_social", False, "alta"),
    ("Jamás he perdido la paciencia, ni siquiera cuando estoy muy cansado o estresado.", "MENTIRA", "deseabilidad_social", False, "extrema"),
    ("Nunca me he reído o sonreído ante un chiste de mal gusto o una situación inapropiada.", "MENTIRA", "deseabilidad_social", False, "extrema"),
]

PILLARS = ["ORDEN", "DESCUENTO", "LOCUS", "MENTIRA"]

# --- FIXED VALUES: payment-history question and its options ------------------
PAYMENT_QUESTION = ("(Pregunta 100% ANÓNIMA): En los últimos 12 meses, ¿te has retrasado más de "
                    "30 días en el pago de alguna obligación (tarjeta, préstamo, cuota de estudios, "
                    "recibo de servicios)?")
PAYMENT_FRAGMENT = "Pregunta 100% ANÓNIMA"
PAYMENT_OPTIONS = [
    "Sí, me he retrasado o he tenido dificultades para pagar en la fecha indicada.",
    "No, siempre he pagado todas mis obligaciones a tiempo.",
    "No he tenido ninguna obligación o deuda a mi nombre en el último año.",
]

# --- FIXED VALUES: target coding -------------------------------------------
TARGET_POSITIVE = "Sí"

# --- FIXED VALUES: columns dropped before training / in the respondent export
DROPPED_FEATURES = ["EDAD", "SITUACION LABORAL"]
EXCLUDED_EXACT = ["Marca temporal", "EDAD", "SITUACION LABORAL"]
EXCLUDED_PREFIXES = ["Consentimiento"]
COLUMN_RENAMES = {
    "DISTRITO DE RESIDENCIA": "DISTRITO",
    "NIVEL EDUCATIVO": "NIVEL_EDUCATIVO",
}

# --- FIXED VALUES: credit policy (strict upper bound, state, tier, amount) ---
POLICY = [
    (0.30, "Pre-aprobado", "S/800 — Pre-aprobado", 800.0),
    (0.35, "Pre-aprobado", "S/300 — Crédito limitado", 300.0),
    (float("inf"), "Denegado", "S/0 — Denegado", 0.0),
]

# --- FIXED VALUES: fuzzy-match cutoff and sensitivity perturbation counts ----
FUZZY_CUTOFF = 0.85
PERTURBATION_COUNTS = [1, 2, 3, 5]
RANDOM_SEED = 42
AUC_TOLERANCE = 1e-6
SMOKE_TEST_SAMPLES = 5
TOP_FEATURES = 10
TOP_GLOBAL = 15

# --- FIXED VALUES: vocabularies the model was trained on ---------------------
TRAIN_DISTRICTS = ["Ate", "Barranco", "Breña", "Carabayllo", "Chaclacayo", "Chorrillos", "Cieneguilla", "Comas", "El Agustino", "Independencia", "Jesús María", "La Molina", "La Victoria", "Lima", "Lince", "Los Olivos", "Lurigancho", "Lurín", "Magdalena del Mar", "Miraflores", "Pachacámac", "Pucusana", "Pueblo Libre", "Puente Piedra", "Punta Hermosa", "Punta Negra", "Rímac", "San Bartolo", "San Borja", "San Isidro", "San Juan de Lurigancho", "San Juan de Miraflores", "San Luis", "San Martín de Porres", "San Miguel", "Santa Anita", "Santa María del Mar", "Santa Rosa", "Santiago de Surco", "Surquillo", "Villa El Salvador", "Villa María del Triunfo"]
TRAIN_EDUCATION = ["Secundaria Incompleta", "Secundaria Completa", "Instituto Técnico Incompleto", "Instituto Técnico Completo", "Escuela de Educación Superior Incompleta", "Escuela de Educación Superior Completa", "Universidad Incompleta", "Universidad Completa", "Postgrado"]
TRAIN_JOBS = ["Estudiante", "Dependiente Formal", "Dependiente Informal", "Independiente Formal", "Independiente Informal", "Desempleado", "Jubilado"]

# --- FIXED VALUES: submission-form vocabularies ------------------------------
FORM_DISTRICTS = ["Ancón", "Ate", "Barranco", "Breña", "Carabayllo", "Cercado de Lima", "Chaclacayo", "Chorrillos", "Cieneguilla", "Comas", "El Agustino", "Independencia", "Jesús María", "La Molina", "La Victoria", "Lince", "Los Olivos", "Lurigancho-Chosica", "Lurín", "Magdalena del Mar", "Miraflores", "Pachacámac", "Pucusana", "Pueblo Libre", "Puente Piedra", "Punta Hermosa", "Punta Negra", "Rímac", "San Bartolo", "San Borja", "San Isidro", "San Juan de Lurigancho", "San Juan de Miraflores", "San Luis", "San Martín de Porres", "San Miguel", "Santa Anita", "Santa María del Mar", "Santa Rosa", "Santiago de Surco", "Surquillo", "Villa El Salvador", "Villa María del Triunfo"]
FORM_EDUCATION = ["Sin educación formal", "Primaria Incompleta", "Primaria Completa", "Secundaria Incompleta", "Secundaria Completa", "Instituto Técnico Incompleto / En curso", "Instituto Técnico Completo", "Escuela de Educación Superior Incompleta / En curso", "Escuela de Educación Superior Completa", "Universitaria Incompleta / En curso", "Universitaria Completa", "Bachiller", "Titulado", "Maestría", "Doctorado"]
FORM_JOBS = ["Desempleado", "Trabajo del hogar no remunerado", "Estudiante", "Trabajo eventual", "Independiente Informal", "Independiente Formal", "Dueño de negocio", "Dependiente Formal", "Docente"]
AGE_MIN = 15
AGE_MAX = 80

# --- FIXED VALUES: friendly dashboard labels ---------------------------------
LABEL_PAYMENT = "Historial de morosidad (12 meses)"
LABEL_DISTRICT = "Distrito de residencia"
LABEL_EDUCATION = "Nivel educativo"

def item_code(position: int) -> str:
    """1-based dictionary position -> stable column-safe code (q01..q30)."""
    return f"q{position:02d}"


ITEM_CODES = [item_code(i + 1) for i in range(len(ITEMS))]
