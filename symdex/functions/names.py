"""Names, suffixes and words that results depend on. Sorted; compared as they stand."""

#: Directories that are skipped at any depth.
SKIPPED_DIRS = frozenset(
    """.amplify .angular .build .cache .cargo .code_index .coverage .eggs .env .expo .git .gradle .hg .idea .maven .mypy_cache
    .netlify .next .nuxt .old .output .parcel-cache .pnp .pytest_cache .sass-cache .serverless .svn .swc .terraform .tmp .tox
    .turbo .venv .vercel .vs .vscode .yarn __MACOSX __pycache__ _build _internal ai1wm-backups archives Avada backups Betheme
    bin bower_components breeze-cache build coverage dist Divi endurance-page-cache enfold env et-cache htmlcov Jupiter
    litespeed-cache logs node_modules obj old out output Salient site-packages smush-webp target tmp twentyeighteen
    twentyfifteen twentynineteen twentyseventeen twentysixteen twentytwenty twentytwentyfive twentytwentyfour
    twentytwentyone twentytwentythree twentytwentytwo updraft upgrade-temp-backup uploads vendor venv w3tc-config wflogs
    wordpress wp-admin wp-includes wp-rocket-config X""".split()
)
#: This engine's own folder in a project, passed over like them.
OWN_DIR = ".symdex"
#: Directories that are skipped below a directory of that name.
SKIPPED_BELOW = {
    "wp-content": frozenset("cache languages mu-plugins-old plugins plugins-old themes-old upgrade wp-rocket".split()),
    "mu-plugins": frozenset("endurance-page-cache kinsta-mu-plugins object-cache-pro pantheon-mu-plugin wp-stack-cache wpe-cache-plugin wpe-update-source-selector wpe-wp-sign-on-plugin wpengine-common".split()),
}
#: Child directories that tell a content directory under another name.
CONTENT_MARKERS = frozenset("mu-plugins plugins themes uploads".split())
SKIPPED_DIR_SUFFIXES = (".egg-info", ".old")
SKIPPED_ROOT_DIRS = frozenset({"n"})

EXTENSIONS = {
    "python": ".py".split(),
    "js_ts": ".cjs .js .jsx .mjs .ts .tsx".split(),
    "php": ".php .php3 .php4 .php5 .phps .phtml".split(),
    "web": ".css .htm .html .less .scss .svelte .vue".split(),
    "config": ".cfg .conf .ini .json .toml .yaml .yml".split(),
    "doc": ".md .rst .txt".split(),
    "template": ".ejs .hbs .j2 .jinja .jinja2 .pug".split(),
    "shell": ".bash .bat .cmd .ps1 .sh .zsh".split(),
    "data": ".gql .graphql .proto .sql".split(),
    "other_code": ".c .cpp .cs .go .h .hpp .java .kt .rb .rs .swift".split(),
}
INDEXED_EXTENSIONS = frozenset(e for group in EXTENSIONS.values() for e in group)
INDEXED_NAMES = frozenset(
    """.dockerignore .eslintrc .gitignore .prettierrc CLAUDE.md docker-compose.yaml docker-compose.yml Dockerfile Gemfile
    Makefile package.json Pipfile Procfile pyproject.toml Rakefile requirements.txt setup.cfg tsconfig.json
    webpack.config.js""".split()
)
LEAST_BYTES, MOST_BYTES = 10, 500_000

#: Files whose name alone says that they are not worth indexing.
SYSTEM_FILES = frozenset(
    """.DS_Store cargo.lock composer.lock desktop.ini flake.lock Gemfile.lock package-lock.json Pipfile.lock pnpm-lock.yaml
    poetry.lock readme.html Thumbs.db wp-activate.php wp-blog-header.php wp-cli.yml wp-comments-post.php
    wp-config-sample.php wp-config.php wp-cron.php wp-links-opml.php wp-load.php wp-login.php wp-mail.php wp-settings.php
    wp-signup.php wp-trackback.php xmlrpc.php yarn.lock""".split()
)
#: Phrases in the head of generated files, in lower case.
GENERATED_MARKERS = (
    "auto generated", "auto-generated", "autogenerated", "automatically generated", "code generated", "do not edit", "do not modify",
    "don't edit", "generated by", "generated from", "generated with", "machine generated", "this file is generated",
)
HEAD_BYTES, MARKER_CHARS, MOST_MEAN_LINE = 4096, 1000, 500

#: Factors on fused scores by kind of symbol; other kinds have OTHER_BOOST.
BOOSTS = {"class": 1.1, "constant": 1.0, "file_summary": 0.7, "function": 1.15, "method": 1.15, "route": 1.1, "section": 0.6}
OTHER_BOOST = 0.8

LANGUAGES = {
    "astro": "Astro", "c": "C", "cpp": "C++", "cs": "C#", "css": "CSS", "go": "Go", "html": "HTML", "java": "Java", "js": "JavaScript", "jsx": "JSX", "kt": "Kotlin", "lua": "Lua", "php": "PHP",
    "ps1": "PowerShell", "py": "Python", "rb": "Ruby", "rs": "Rust", "sass": "Sass", "scss": "SCSS", "sh": "Shell", "sql": "SQL", "svelte": "Svelte", "swift": "Swift", "ts": "TypeScript", "tsx": "TSX", "vue": "Vue",
}
HIDDEN_TOP_LEVEL = frozenset(".code_index .git .next .nuxt __pycache__ build dist node_modules out uploads vendor wp-admin wp-includes".split())

SITE_FOLDERS = ("public_html", "restore/public_html", "web", "html", "www")
URL_KEYS = "APP_DOMAIN APP_URL BASE_URL SITE_URL WP_HOME WP_SITEURL".split()
MAIL_KEYS = "MAIL_FROM_ADDRESS MAIL_USERNAME".split()
DATABASE_KEYS = "DATABASE_NAME DB_NAME MARIADB_DATABASE MYSQL_DATABASE".split()
WEB_ROOTS = (*SITE_FOLDERS, "htdocs", "webroot")
WEB_ROOT_FILES = ("index.html", "index.php", "wp-config.php")
#: In this order the first that exists names the platform.
PLATFORM_FILES = {
    "artisan": "Laravel", "manage.py": "Django", "next.config.js": "Next.js", "next.config.ts": "Next.js",
    "nuxt.config.js": "Nuxt.js", "nuxt.config.ts": "Nuxt.js", "svelte.config.js": "SvelteKit", "astro.config.mjs": "Astro",
}
COMPOSE_FILES = ("docker/docker-compose.yml", "docker-compose.yml", "docker/docker-compose.yaml", "docker-compose.yaml")
#: In this order they are reported.
CACHE_PLUGINS = {
    "wp-rocket": "WP Rocket", "w3-total-cache": "W3 Total Cache", "sucuri-scanner": "Sucuri", "litespeed-cache": "LiteSpeed Cache",
    "wp-super-cache": "WP Super Cache", "wp-fastest-cache": "WP Fastest Cache", "breeze": "Breeze (Cloudways)",
    "wp-cloudflare-page-cache": "Cloudflare Page Cache", "autoptimize": "Autoptimize", "sg-cachepress": "SG Optimizer",
    "endurance-page-cache": "Endurance Page Cache",
}
DEFAULT_THEMES = frozenset("twenty" + year for year in "fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour twentyfive".split())
