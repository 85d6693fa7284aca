"""Vocabulary and constants.

Fixed values: word lists, points and labels here must be what they are for results to agree. They are plain
text in their order; operators take them as parameters, so another domain brings its own.
"""

from __future__ import annotations


EASY_APPLY, EXTERNAL_APPLY, UNKNOWN_APPLY = "linkedin_easy_apply", "external_apply", "unknown"

BASE_SCORE = 35
TARGET_POINTS, TARGET_CAP = 5, 30
SKILL_POINTS, SKILL_CAP = 2, 10
NO_REASON = "Sin coincidencias claras; revisar manualmente"
SKILLS_REASON = "Coincide con habilidades del perfil"
DEFAULT_TARGET = "soporte_aplicaciones"
INFERRED_TARGETS = ("backend_junior", "frontend_junior", "fullstack_junior", "devops_trainee", "soporte_aplicaciones")
SKILL_STOPWORDS = ("junior", "trainee", "bogota", "colombia")

# term, points, reason
ENTRY_POINTS = (
    ("junior", 18, "Acepta perfil junior"),
    ("trainee", 18, "Acepta perfil trainee"),
    ("aprendiz", 12, "Acepta perfil de entrada"),
    ("practicante", 12, "Acepta perfil practicante"),
    ("entry level", 12, "Acepta perfil entry level"),
    ("sin experiencia", 10, "Acepta perfil sin experiencia"),
    ("recien egresado", 10, "Acepta perfil recien egresado"),
    ("0 a 1 ano", 10, "Pide poca experiencia"),
    ("1 ano", 7, "Pide experiencia inicial"),
    ("remoto", 5, "Modalidad remota"),
    ("hibrido", 4, "Modalidad hibrida"),
)
PENALTY_POINTS = (
    ("senior", -26, "Pide perfil senior"),
    ("semi senior", -20, "Pide perfil semi senior"),
    ("semisenior", -20, "Pide perfil semi senior"),
    ("lider", -18, "Pide rol de liderazgo"),
    ("arquitecto", -20, "Pide rol de arquitectura"),
    ("4 anos", -18, "Pide experiencia superior a 3 anos"),
    ("5 anos", -20, "Pide experiencia alta"),
    ("mas de 3 anos", -18, "Pide mas de 3 anos"),
    ("experiencia avanzada", -16, "Exige experiencia avanzada"),
    ("ingles avanzado", -14, "Exige ingles avanzado"),
    ("kubernetes avanzado", -14, "Exige Kubernetes avanzado"),
    ("terraform avanzado", -14, "Exige Terraform avanzado"),
)

SENIOR = ("senior", "semi senior", "semisenior", "lider", "lider tecnico", "lead", "arquitecto", "architect", "coordinador", "manager", "jefe", "+3 anos", "3+ anos", "minimo 3 anos", "mas de 3 anos", "4 anos", "5 anos", "experiencia avanzada", "experto", "especialista senior")
ENTRY = ("junior", "trainee", "aprendiz", "practicante", "intern", "estudiante en practica", "estudiante en practicas", "estudiante practica", "practica", "practicas", "tecnico", "tecnologo", "entry level", "recien egresado", "0 a 1 ano", "1 ano", "sin experiencia", "desarrollador junior", "analista junior")
ADMINISTRATIVE = ("asesor", "recepcionista", "logistica", "logistico", "automotriz", "comercial", "contable", "abogado", "contador", "promotor", "libranza", "seguros", "nomina", "postventas", "operativo", "administrativo", "ventas")
FRONT_FALSE_FRIENDS = ("front desk", "front office", "frontoffice")

TITLE_SIGNALS = {
    "backend_junior": ("backend", "back-end", "desarrollador backend", "python", "java", "node.js", "node", "api", "apis", "sql", "postgresql", "mysql", "bases de datos", "base de datos", "desarrollo de software", "fullstack", "full stack", "full-stack"),
    "frontend_junior": ("frontend", "front-end", "front end", "desarrollador frontend", "desarrollador front end", "desarrollador web", "desarrollo front", "flutter", "react", "angular", "vue", "html", "css", "javascript", "typescript", "ecommerce", "e-commerce", "fullstack", "full stack", "front y back", "frontend y backend"),
    "fullstack_junior": ("fullstack", "full stack", "full-stack", "developer fullstack", "desarrollador fullstack", "desarrollador full stack", "front y back", "frontend y backend", "desarrollo web"),
    "devops_trainee": ("devops", "ingeniero devops", "devops engineer", "junior devops"),
    "soporte_aplicaciones": ("soporte de aplicaciones", "application support", "soporte tecnico", "mesa de ayuda", "help desk"),
    "infraestructura_junior": ("it", "sistemas", "tecnologia de la informacion", "mantenimiento de equipos", "soporte ti", "auxiliar de sistemas", "tecnico de sistemas", "area it", "it sistemas", "infraestructura", "hardware", "software", "mantenimiento"),
    "cloud_support": ("cloud", "aws", "azure", "gcp", "soporte cloud"),
    "qa_junior": ("qa", "testing", "pruebas", "quality assurance"),
}
CONTENT_SIGNALS = {
    "backend_junior": ("backend", "back-end", "node.js", "express", "nestjs", "python", "java", "spring boot", "c#", ".net", "api", "apis", "sql", "postgresql", "mysql", "mongodb", "bases de datos", "base de datos", "desarrollo de software"),
    "frontend_junior": ("frontend", "front-end", "front end", "flutter", "react", "angular", "vue", "html", "css", "javascript", "typescript", "ecommerce", "e-commerce", "desarrollo web", "ui", "componentes"),
    "fullstack_junior": ("fullstack", "full stack", "full-stack", "front y back", "frontend y backend", "react", "javascript", "typescript", "node.js", "python", "java", "api", "apis", "sql", "postgresql", "mysql", "desarrollo web"),
    "devops_trainee": ("devops", "docker", "linux", "ci/cd", "github actions", "cloud", "aws", "azure", "gcp", "despliegue", "automatizacion", "pipelines", "terraform", "kubernetes"),
    "soporte_aplicaciones": ("soporte", "tickets", "incidencias", "usuarios", "sql", "aplicaciones web", "application support", "mesa de ayuda"),
    "infraestructura_junior": ("it", "sistemas", "carreras sistemas o afines", "tecnologia de la informacion", "mantenimiento de equipos", "soporte ti", "auxiliar de sistemas", "tecnico de sistemas", "area it", "it sistemas", "infraestructura", "hardware", "software", "configuracion de equipos", "mantenimiento"),
    "cloud_support": ("cloud", "aws", "azure", "gcp", "docker", "linux", "despliegue"),
    "qa_junior": ("qa", "testing", "pruebas", "bugs", "casos de prueba", "validacion", "apis"),
}
FULLSTACK_FRONT = ("frontend", "front-end", "front end", "front y back", "frontend y backend", "react", "next.js", "javascript", "typescript", "html", "css", "flutter", "vue", "angular")
FULLSTACK_BACK = ("backend", "back-end", "node.js", "express", "python", "java", "api", "apis", "sql", "postgresql", "mysql", "mongodb")

SCORE_KEYWORDS = {
    "devops_trainee": ("devops", "docker", "linux", "ci/cd", "cloud", "aws", "azure", "despliegue", "automatizacion", "vercel", "neon", "postgresql", "git", "github"),
    "soporte_aplicaciones": ("soporte", "soporte a usuarios", "incidencias", "tickets", "aplicaciones", "aplicaciones web", "sql", "documentacion", "reportes", "diagnostico"),
    "infraestructura_junior": ("infraestructura", "mantenimiento", "hardware", "software", "redes", "equipos de computo", "inventario", "soporte tecnico", "configuracion", "linea de comandos"),
    "cloud_support": ("cloud", "aws", "azure", "monitoreo", "logs", "soporte", "despliegue", "vercel", "neon"),
    "qa_junior": ("qa", "pruebas", "testing", "casos de prueba", "bugs", "validacion", "documentacion", "reportes", "apis"),
    "backend_junior": ("backend", "back-end", "desarrollador backend", "node.js", "node", "express", "nestjs", "python", "java", "spring boot", "c#", ".net", "apis rest", "rest api", "json", "sql", "postgresql", "mysql", "mongodb", "autenticacion", "logica de negocio", "integracion de apis", "git", "github", "docker", "pruebas unitarias"),
    "frontend_junior": ("frontend", "front-end", "desarrollador frontend", "html", "css", "javascript", "typescript", "react", "next.js", "angular", "vue", "tailwind", "bootstrap", "responsive", "diseno responsivo", "consumo de apis", "interfaces", "ui", "componentes", "git", "github", "vercel"),
    "fullstack_junior": ("fullstack", "full stack", "desarrollador fullstack", "frontend", "backend", "react", "next.js", "node.js", "express", "typescript", "javascript", "apis", "sql", "postgresql", "mysql", "mongodb", "dashboards", "e-commerce", "panel administrativo", "autenticacion", "despliegue", "vercel", "neon", "git", "github"),
}
PRETTY = {"node.js": "Node.js", "next.js": "Next.js", "apis rest": "APIs REST", "rest api": "REST API", "postgresql": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "javascript": "JavaScript", "typescript": "TypeScript", "github": "GitHub"}

# first label whose terms a listing holds, in this order
TARGET_LABELS = (
    ("fullstack_junior", ("full stack", "fullstack", "react", "next.js", "node.js", "express", "postgresql", "e-commerce")),
    ("soporte_aplicaciones", ("soporte", "tickets", "incidencias", "aplicaciones", "sql", "usuarios")),
    ("infraestructura_junior", ("infraestructura", "mantenimiento", "hardware", "redes", "equipos de computo", "soporte tecnico")),
    ("devops_trainee", ("devops", "docker", "linux", "ci/cd", "cloud", "despliegue", "vercel", "neon")),
    ("cloud_support", ("aws", "azure", "cloud support", "monitoreo", "logs")),
    ("qa_junior", ("qa", "pruebas", "testing", "casos de prueba", "bugs")),
    ("backend_junior", ("backend", "api", "python", "java", "node", "express", "nestjs", ".net", "spring boot")),
    ("frontend_junior", ("frontend", "front-end", "react", "next.js", "typescript", "javascript", "tailwind", "angular", "vue")),
)

TRACKING_PARAMS = ("currentjobid", "gh_jid", "mc_eid", "ref", "refid", "sessionid", "source", "trackingid", "trk", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

MODALITIES = (("Remoto", ("remoto", "remote", "home office")), ("Híbrido", ("hibrido", "híbrido", "hybrid")), ("Presencial", ("presencial", "onsite", "on-site")))

TODAY_WORDS, YESTERDAY_WORDS = ("hoy", "today", "just posted", "new"), ("ayer", "yesterday")

# token, reason, kind
BLOCK_TEXTS = (
    ("verifica que no eres un robot", "texto visible de captcha"),
    ("verify you are human", "texto visible de captcha"),
    ("access denied", "access denied visible"),
    ("forbidden", "forbidden visible"),
    ("attention required", "cloudflare challenge visible"),
    ("enable javascript and cookies to continue", "cloudflare challenge visible"),
)
LOGIN_TEXTS = ("inicia sesion para continuar", "iniciar sesion para continuar", "sign in to continue", "login required", "accede con tu cuenta")
CHALLENGE_MARKS = ("cf-browser-verification", "cf-chl-")

TOKEN_STOPWORDS = ("a", "al", "and", "con", "de", "del", "el", "en", "for", "in", "la", "las", "los", "of", "o", "para", "por", "pro", "se", "software", "the", "to", "un", "una", "web", "y")
SHORT_TOKENS = ("sql", "c#", "c++")
CONNECTORS = ("y", "con", "de", "en", "para", "por")

TECHNOLOGIES = (
    ("PostgreSQL", r"\b(postgresql|postgres)\b"), ("MySQL", r"\bmysql\b"), ("SQL", r"\bsql\b"), ("JavaScript", r"\bjavascript\b"), ("TypeScript", r"\btypescript\b"),
    ("React", r"\breact\b"), ("Next.js", r"\bnext\.?js\b"), ("Node.js", r"\bnode\.?js\b"), ("Express", r"\bexpress\b"), ("Python", r"\bpython\b"),
    ("Java", r"\bjava\b"), ("Git", r"\bgit\b"), ("GitHub", r"\bgithub\b"), ("Linux", r"\blinux\b"), ("Docker", r"\bdocker\b"),
    ("Vercel", r"\bvercel\b"), ("Neon", r"\bneon\b"), ("PHP", r"\bphp\b"), ("MongoDB", r"\bmongodb\b"), ("Redis", r"\bredis\b"),
)

MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

# Ways to apply: what texts and controls say.
EASY_APPLY_SIGNALS = ("solicitud sencilla", "solicitud simple", "solicitar facilmente", "easy apply", "easyapply")
EXTERNAL_APPLY_SIGNALS = ("solicitar en el sitio web de la empresa", "apply on company website")
APPLY_CONTROLS = ("solicitar", "solicitar ahora", "apply", "apply now")
DETAIL_PANELS = (
    "div.jobs-search__job-details--container", "div.jobs-details", "div.jobs-details__main-content", "div.job-details-jobs-unified-top-card", "div.jobs-unified-top-card", "section.top-card-layout", "div.top-card-layout",
)

# Search filters of one portal: names and codes.
DATE_POSTED_CODES = {"24h": "r86400", "week": "r604800", "month": "r2592000"}
EXPERIENCE_CODES = {"internship": "1", "entry_level": "2", "associate": "3", "1": "1", "2": "2", "3": "3"}
WORKPLACE_CODES = {"onsite": "1", "remote": "2", "hybrid": "3", "1": "1", "2": "2", "3": "3"}

# Pages of one portal: selectors of public cards and of cards after a login, signs of no results and of walls.
PUBLIC_CARDS = ("div.base-card", "div.base-search-card", "div.job-search-card", "ul.jobs-search__results-list li", "a.base-card__full-link", "h3.base-search-card__title")
LOGGED_CARDS = ("li.jobs-search-results__list-item", "div.job-card-container", "div.job-card-list", "a.job-card-container__link", "a.job-card-list__title")
LOGGED_LIST, LOGGED_ITEMS = "div.scaffold-layout__list-container", ("li", "div.job-card-container", "div.job-card-list", "a[href*='/jobs/view/']")
NO_RESULTS = (
    "no se han encontrado coincidencias", "no se encontraron coincidencias", "no hay resultados", "no results found", "no matching jobs found",
    "comprueba que las palabras clave estén bien escritas", "comprueba que las palabras clave esten bien escritas",
)
# token or selector, reason, kind; those of WALLS count only on pages without cards
WALL_TEXTS = (
    ("captcha", "captcha", "captcha"), ("recaptcha", "recaptcha", "captcha"), ("security verification", "security verification", "captcha"), ("security check", "security check", "captcha"),
    ("verify you are human", "captcha", "captcha"), ("checkpoint", "checkpoint", "login"),
)
LOGIN_WALL_TEXTS = ("authwall", "youre almost there", "you're almost there", "you’re almost there")
WALL_SELECTORS = (
    ("form[action*='checkpoint']", "checkpoint", "login"), ("form[action*='captcha']", "captcha", "captcha"), ("iframe[src*='captcha']", "captcha", "captcha"),
    ("iframe[src*='recaptcha']", "recaptcha", "captcha"), (".g-recaptcha", "captcha", "captcha"),
)
LOGIN_WALL_SELECTORS = (".authwall", "[class*='authwall']")
SOFT_LOGIN_TEXTS = ("login", "sign in", "join linkedin", "inicia sesion", "inicia sesión", "iniciar sesion", "iniciar sesión", "unirte a linkedin")

# Detail pages of one portal: selectors by field, words of page furniture.
DETAIL_SELECTORS = {
    "title": ("h1", ".box_detail h1", ".offer__title", "[data-cy='job-title']"),
    "company": (".box_company h2", ".box_company a", ".company", "[data-cy='company-name']"),
    "location": (".box_detail .fc_aux", ".box_detail .mb5", ".location", "[data-cy='job-location']"),
    "posted": ("time", ".fc_aux.fs13", ".box_detail .fc_aux", "[data-cy='job-posted-date']"),
    "description": (".box_detail .mbB", ".box_detail .text-description", ".box_detail [data-cy='job-description']", ".offer-description", ".description"),
    "requirements": (".box_detail .mt20 ul li", ".box_detail .requirements li", ".requirements li", ".box_detail .requirements"),
    "modality": (".box_detail .tag.base", ".box_detail .fc_aux", ".box_detail .mb5"),
    "salary": (".box_detail .tag.base", ".salary", "[data-cy='job-salary']"),
}
FURNITURE = ("publicada", "hace ", "aplicar", "postularme", "guardar", "denunciar", "compartir", "ver mas", "ver menos", "candidatos")
