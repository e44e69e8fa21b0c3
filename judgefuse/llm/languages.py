"""Very frequent function words of four languages (fixed values, natural order)."""

STOP_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "her", "his",
           "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "their", "this", "to", "was", "were",
           "which", "with", "you"],
    "de": ["als", "am", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einer",
           "er", "es", "für", "ich", "im", "in", "ist", "mit", "nach", "nicht", "oder", "sich", "sie", "sind", "und",
           "von", "war", "wie", "zu", "zum", "zur"],
    "fr": ["au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "ils", "je",
           "la", "le", "les", "mais", "ne", "ou", "par", "pas", "plus", "pour", "qu", "que", "qui", "se", "son", "sur",
           "un", "une", "vous"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "esta", "este", "fue", "ha", "la", "las", "lo", "los",
           "más", "no", "o", "para", "pero", "por", "que", "se", "sin", "su", "sus", "un", "una", "uno", "y", "ya"],
}
LANGUAGES = list(STOP_WORDS)
