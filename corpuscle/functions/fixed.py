"""Names, extensions and patterns that results depend on."""

LANGUAGE_BY_EXTENSION = {
    ".cs": "csharp", ".csx": "csharp",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyw": "python", ".pyi": "python",
    ".java": "java", ".kt": "java", ".scala": "java",
    ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".hh": "cpp", ".cxx": "cpp", ".hxx": "cpp",
}
EXCLUDED_DIRS = {
    "source": [".git", ".hg", ".idea", ".nuget", ".specstory", ".svn", ".vs", ".vscode", "bin", "build", "dist", "node_modules", "obj", "out", "packages", "target", "vendor"],
    "modules": [".git", ".svn", ".hg", ".vs", ".vscode", ".idea", "node_modules", "bin", "obj", "packages", "dist", "build", "out", "target", "__pycache__", ".pytest_cache", ".mypy_cache", "venv", "env", "vendor", "bower_components", ".nuget", ".angular", "coverage"],
    "code": ["node_modules", "bin", "obj", "packages", ".git", ".svn", ".hg", ".vs", ".vscode", ".idea", "dist", "build", "out", "target", "__pycache__", ".pytest_cache", ".mypy_cache", "venv", "env", "vendor", "bower_components", ".nuget"],
    "search": [".git", "bin", "obj"],
    "upload": [".git", "node_modules", "bin", "obj", ".vs", ".vscode", ".idea", "dist", "build", "out", "target", "__pycache__", "venv", ".venv"],
}
UPLOAD_EXTENSIONS = [
    ".cs", ".fs", ".vb", ".js", ".ts", ".jsx", ".tsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx",
    ".htm", ".html", ".css", ".md", ".json", ".xml", ".toml", ".yml", ".yaml", ".sql", ".csproj", ".fsproj", ".vbproj", ".sln",
]
UPLOAD_FILES = ["package.json", "package-lock.json", "requirements.txt", "pyproject.toml", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "pom.xml", "build.gradle", "cmakelists.txt", "dockerfile", ".gitignore", ".editorconfig", "makefile"]
EXECUTABLE_MAGIC = ["7F454C46", "FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE", "CAFEBABE"]
ROLE_RULES = [
    (["Controllers", "Endpoints", "Routes", "Api", "Handlers"], "API Layer"),
    (["Services", "Application", "UseCases", "Commands", "Queries"], "Business Logic"),
    (["Models", "Entities", "Domain", "DTOs", "ViewModels"], "Domain Layer"),
    (["Data", "Repositories", "Repository", "Infrastructure", "Persistence", "DAL"], "Data Layer"),
    (["wwwroot", "Views", "Pages", "Components", "UI", "Frontend", "ClientApp"], "UI Layer"),
    (["Tests", "Test", "Specs", "Spec", "__tests__", "UnitTests", "IntegrationTests"], "Tests"),
    (["Middleware", "Filters", "Interceptors", "Pipeline"], "Cross-Cutting"),
    (["Config", "Configuration", "Settings", "Options"], "Configuration"),
    (["Migrations", "Seeds", "Seeders"], "Database Migrations"),
    (["Providers", "Adapters", "Clients", "External"], "External Integration"),
    (["Analysis", "Analyzers"], "Analysis"),
    (["Tools", "Utilities", "Utils", "Helpers", "Common", "Shared", "Lib"], "Utilities"),
]
ENTRY_POINTS = ["Program.cs", "Startup.cs", "Main.cs", "main.go", "main.py", "app.py", "manage.py", "index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.js", "server.ts", "server.js", "Main.java", "App.java", "Application.java", "main.rs", "lib.rs"]
KEYWORD_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "what which who whom whose where when why how this that these those here there and or but if then else for from to of in on at with about "
    "into through during before after please help want like know tell show find look 問題 請問 如何 怎麼 什麼 哪裡 為什麼 可以 能夠 關於"
).split()
CANDIDATE_STOP_WORDS = ["API", "URL", "HTTP", "HTTPS", "JSON", "SQL", "ID", "UI", "CRUD", "REST"]
CAMEL = r"\b[A-Za-z_][a-z0-9]*[A-Z][A-Za-z0-9_]*\b"
SIMPLE_QUESTION = r"(?i)^\s*(where is|what is|which file|what does|show me the definition of|find the definition of|哪個檔案|在哪|是什麼|定義在哪)\b"
COMPLEX_QUESTION = r"(?i)how does .* work|trace|end[- ]to[- ]end|explain the flow|what happens when|impact of|architecture|walk me through|流程|架構|為什麼"
# Call names, and qualifiers, that are no calls of a corpus, by language; case counts.
_JS_BUILTINS = (
    "console require parseInt parseFloat setTimeout setInterval clearTimeout clearInterval JSON Math Object Array String Number Boolean Promise Date RegExp Map Set "
    "Error TypeError RangeError Symbol WeakMap WeakSet encodeURIComponent decodeURIComponent encodeURI decodeURI isNaN isFinite"
).split()
_C_BUILTINS = (
    "printf fprintf sprintf snprintf scanf fscanf sscanf malloc calloc realloc free memcpy memset memmove strcmp strncmp strcpy strncpy strlen strcat strncat "
    "fopen fclose fread fwrite fgets fputs feof fflush exit abort atexit atoi atof atol strtol strtod assert perror"
).split()
SKIP_CALLS = {
    "javascript": [*_JS_BUILTINS, "alert", "confirm", "prompt"],
    "typescript": _JS_BUILTINS,
    "python": (
        "print len range int str float bool list dict tuple set type isinstance issubclass hasattr getattr setattr delattr super property staticmethod classmethod "
        "enumerate zip map filter sorted reversed any all min max sum abs round open input repr hash id dir vars globals locals callable iter next format chr ord hex oct bin "
        "bytearray bytes memoryview frozenset complex divmod pow eval exec compile breakpoint exit quit"
    ).split(),
    "java": "System String Integer Long Double Float Boolean Object Class Math Collections Arrays List Map Set Optional Stream Collectors".split(),
    "go": (
        "fmt log os io strings strconv errors context sync time math sort bytes bufio regexp path filepath encoding json http net reflect runtime "
        "make len cap append copy delete close panic recover new println"
    ).split(),
    "rust": (
        "println eprintln format vec panic assert assert_eq assert_ne debug_assert todo unimplemented unreachable write writeln include_str include_bytes env cfg "
        "Box Vec String Option Result Ok Err Some None"
    ).split(),
    "c": [*_C_BUILTINS, "errno"],
    "cpp": [*_C_BUILTINS, *"std cout cin cerr endl make_shared make_unique make_pair make_tuple static_cast dynamic_cast reinterpret_cast const_cast move forward swap begin end".split()],
    "csharp": [],
}
CALLEES_PER_SYMBOL = 50
# A call by language: what it is called on, if anything, then its name, type arguments and the bracket.
_NAME = r"([A-Za-z_]\w*)"
CALLS = {
    "python": rf"(?:{_NAME}\s*\.\s*)?{_NAME}\s*\(",
    "javascript": r"(?:([A-Za-z_$][\w$]*)\s*(?:\?\.|!?\.)\s*)?#?([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.$|&\[\]]*(?:<[\w\s,.$|&\[\]]*>[\w\s,.$|&\[\]]*)*>)?\s*(?:\?\.)?\(",
    "java": rf"(?:{_NAME}\s*(?:\.|::)\s*(?:<[\w\s,.?]*>\s*)?)?{_NAME}\s*(?:<[\w\s,.?\[\]]*(?:<[\w\s,.?\[\]]*>[\w\s,.?\[\]]*)*>)?\s*\(",
    "csharp": rf"(?:{_NAME}\s*(?:\?\.|!?\.|::|->)\s*)?@?{_NAME}\s*(?:<[\w\s,.?\[\]]*(?:<[\w\s,.?\[\]]*>[\w\s,.?\[\]]*)*>)?\s*\(",
    "go": rf"(?:{_NAME}\s*\.\s*)?{_NAME}(?:\[[\w\s,.*]*\])?\(",
    "rust": rf"(?:{_NAME}\s*(?:::|\.)\s*)?{_NAME}\s*(?:::\s*<[^()]*?>)?\s*\(",
    "cpp": rf"(?:{_NAME}\s*(?:::|\.|->)\s*)?{_NAME}\s*(?:<[\w\s,:*&]*(?:<[\w\s,:*&]*>[\w\s,:*&]*)*>)?\s*\(",
}
CALLS["typescript"], CALLS["c"] = CALLS["javascript"], CALLS["cpp"]
TYPE_KINDS = ["class", "interface", "struct", "enum", "trait", "record", "type"]
TEST_FRAMEWORKS = {"javascript": "js-test", "typescript": "js-test", "python": "pytest", "java": "JUnit", "go": "Go test", "rust": "Rust test", "c": "gtest/catch2", "cpp": "gtest/catch2", "csharp": "xUnit"}
# Extensions of the wide scan of code, of the plain line search, of documentation, and of binary files.
CODE_EXTENSIONS = (
    ".cs .csx .vb .fs .fsx .js .jsx .ts .tsx .mjs .cjs .py .pyw .pyi .java .kt .kts .scala .go .rs .c .cpp .h .hpp .rb .php .swift .m .mm .sql .graphql .gql .json .xml .yaml .yml .toml "
    ".css .scss .sass .less .html .htm .cshtml .razor .sh .bash .ps1 .psm1 .bat .cmd .log .txt .ini .conf .config"
).split()
SEARCH_EXTENSIONS = ".cs .js .ts .tsx .jsx .py .java .go .rs .c .cpp .h .hpp .rb .php .sql .json .xml .yaml .yml .css .html .cshtml .razor .sh .ps1".split()
DOCUMENT_EXTENSIONS = ".md .rst .doc .docx .pdf .rtf".split()
BINARY_EXTENSIONS = (
    ".exe .dll .pdb .obj .bin .zip .rar .7z .tar .gz .png .jpg .jpeg .gif .bmp .ico .svg .webp .mp3 .mp4 .avi .mov .wav .flac .pdf .doc .docx .xls .xlsx .ppt .pptx .woff .woff2 .ttf .eot .otf"
).split()
ENTRY_DESCRIPTIONS = {
    "program.cs": "ASP.NET Core / .NET host", "startup.cs": "ASP.NET Core startup configuration", "main.go": "Go application entry",
    "main.py": "Python application entry", "app.py": "Python application entry", "manage.py": "Django management script",
    "index.ts": "Node.js / frontend entry", "index.js": "Node.js / frontend entry", "main.ts": "Application main entry", "main.js": "Application main entry",
    "server.ts": "Server entry", "server.js": "Server entry", "app.ts": "Application entry", "app.js": "Application entry",
    "main.java": "Java application entry", "app.java": "Java application entry", "application.java": "Java application entry",
    "main.rs": "Rust binary entry", "lib.rs": "Rust library entry",
}
# Names and argument keys that models use for the tools of the registry; an empty key is left out.
NATIVE_TOOLS = {"search": "grep_search", "search_file": "grep_search", "open_file": "read_file", "print_tree": "list_directory"}
NATIVE_KEYS = {"query": "pattern", "path": "file_path", "depth": "max_depth", "line_start": "offset", "max_results": ""}
GLOBAL_SKIP_CALLS = "if for while switch catch foreach return throw sizeof typeof nameof default else try finally using lock fixed checked unchecked do case print println printf sprintf fprintf".split()
CONTROL_WORDS = "if for while switch catch foreach return throw new sizeof".split()
# An import line's target, by language; C# and Java stop at the first line of another kind.
IMPORT_PATTERNS = {
    "csharp": [r"^\s*using\s+(?!static)([\w.]+)\s*;"],
    "javascript": [r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "python": [r"^\s*from\s+([\w.]+)\s+import", r"^\s*import\s+([\w.]+)"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;"],
}
IMPORT_HEADS = {"csharp": ("using", "//", "#", "global"), "java": ("import", "//", "package")}
