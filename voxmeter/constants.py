"""Fixed values of the feedback domain: lists, weights, limits and thresholds."""

# Fixed values, in their fixed order.
EMOTIONS = ["alegria", "tristeza", "enojo", "miedo", "confianza", "desagrado", "sorpresa", "expectativa", "frustracion", "gratitud", "aprecio", "indiferencia", "decepcion", "entusiasmo", "verguenza", "esperanza"]
CATEGORIES = {
    "positivas": ["alegria", "confianza", "expectativa", "gratitud", "aprecio", "entusiasmo", "esperanza"],
    "negativas": ["tristeza", "enojo", "miedo", "desagrado", "frustracion", "decepcion", "verguenza"],
    "neutras": ["sorpresa", "indiferencia"],
}
NPS_WEIGHTS = {
    "entusiasmo": 2.8, "gratitud": 2.5, "alegria": 2.2, "esperanza": 2.0, "aprecio": 1.8, "confianza": 1.6, "expectativa": 1.3,
    "enojo": -3.0, "frustracion": -2.7, "decepcion": -2.4, "desagrado": -2.1, "verguenza": -1.8, "tristeza": -1.5, "miedo": -1.2,
    "sorpresa": 0.2, "indiferencia": -0.3,
}
PROMOTER_EMOTIONS = ["alegria", "gratitud", "entusiasmo", "esperanza", "confianza"]
DETRACTOR_EMOTIONS = ["enojo", "frustracion", "decepcion", "tristeza", "desagrado"]
RISK_NEGATIVE = ["enojo", "frustracion", "decepcion", "tristeza"]
RISK_POSITIVE = ["alegria", "gratitud", "entusiasmo", "esperanza"]
CHURN_HIGH = ["cancelar", "cerrar cuenta", "dar de baja", "nunca más", "no vuelvo", "pésimo servicio", "horrible", "terrible", "odio", "detesto", "cambiar de proveedor", "buscar alternativa", "competencia", "no recomiendo", "perdieron cliente", "última vez"]
CHURN_MEDIUM = ["decepcionado", "frustrado", "molesto", "insatisfecho", "problema", "queja", "reclamo", "mal servicio", "no cumple", "esperaba más", "no vale la pena"]
PAIN_CATEGORIES = {
    "product": ["calidad", "funcionalidad", "defecto", "roto", "no_funciona"],
    "service": ["atencion", "servicio", "soporte", "ayuda", "respuesta"],
    "delivery": ["entrega", "envio", "demora", "tiempo", "tardanza"],
    "price": ["precio", "caro", "costoso", "valor", "dinero"],
    "usability": ["dificil", "complejo", "confuso", "usar", "interfaz"],
    "communication": ["informacion", "comunicacion", "aviso", "notificar"],
}
NPS_POSITIVE = ["excelente", "muy bueno", "genial", "perfecto", "increible"]
NPS_NEGATIVE = ["malo", "terrible", "horrible", "pesimo", "odio"]
LEXICON_POSITIVE = ["bueno", "excelente", "genial", "perfecto", "increíble", "fantástico"]
LEXICON_NEGATIVE = ["malo", "terrible", "horrible", "pésimo", "odio", "problema"]
LEXICON_EMOTIONS = {
    "positive": ["alegria", "gratitud", "entusiasmo", "esperanza"],
    "negative": ["frustracion", "decepcion", "enojo", "tristeza"],
    "neutral": ["indiferencia", "sorpresa"],
}
SPANISH_INDICATORS = ["el", "la", "es", "en", "de", "que", "y", "se", "no", "un", "por", "con"]

REQUIRED_COLUMNS = ["NPS", "Nota", "Comentario Final"]
EXACT_RENAMES = {"Comentario Final Final": "Comentario Final", "Comentario Final Limpio": "Comentario Final", "Comentario Final Procesado": "Comentario Final"}
ALIASES = {
    "NPS": ["nps", "nps score", "puntaje nps", "score nps", "puntuacion nps", "net promoter score", "promoter score", "score", "puntuacion", "puntaje"],
    "Nota": ["rating", "nota", "calificacion", "calificación", "rating score", "valoracion", "valoración"],
    "Comentario Final": ["comment", "comentario", "comentarios", "feedback", "observaciones", "observacion", "texto"],
}
MOJIBAKE = [("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã‡", "Ç"), ("â€œ", '"'), ("â€?", '"'), ("â€™", "'"), ('â€"', "–"), ("Â´", "'"), ("Â¿", "¿"), ("Â¡", "¡")]
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®")]

MIN_COMMENT, MAX_COMMENT, LONG_COMMENT = 5, 2000, 1000
MIN_ROWS, MAX_ROWS = 1, 50_000
# provider, tier, requests per minute, tokens per minute
TIERS = [
    ("openai", "tier_1", 500, 200_000), ("openai", "tier_2", 5000, 2_000_000), ("openai", "tier_3", 5000, 4_000_000), ("openai", "tier_4", 10_000, 10_000_000), ("openai", "tier_5", 30_000, 150_000_000),
    ("azure", "standard", 2700, 450_000), ("azure", "data_zone_standard", 6000, 1_000_000), ("azure", "global_standard", 12_000, 2_000_000),
]
SAFETY_MARGIN = 0.9
REQUESTS_PER_MINUTE, TOKENS_PER_MINUTE = 450, 200_000
TOKENS_PER_COMMENT, PROMPT_TOKENS, TOKENS_PER_REQUEST, MAX_BATCH = 150, 800, 12_000, 100
SLA_TARGETS = [("pipeline_execution", 10.0), ("file_processing", 2.0), ("llm_batch", 8.0), ("data_export", 3.0), ("chart_generation", 2.0)]
