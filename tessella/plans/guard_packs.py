"""Tables of guarded rules. Ids, patterns, distances and messages are fixed values: results are compared by them."""
from __future__ import annotations

from tessella.operators.guards import Guarded

GO, TS, PY, RS, RB, CS, PHP, SW, KT = (".go",), (".ts", ".tsx", ".js", ".jsx", ".mjs"), (".py",), (".rs",), (".rb", ".rake"), (".cs",), (".php",), (".swift",), (".kt", ".kts")
SLASH, HASH, DASHES = r"^\s*//", r"^\s*#", r"^\s*--"
JAVA, C, SCALA, EX, DART = (".java",), (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx"), (".scala",), (".ex", ".exs"), (".dart",)


def _res(lang: str, name: str, exts: tuple, when: str, message: str, guard: str, after: int, fix: str, **k) -> Guarded:
    return Guarded(f"resource/{lang}-{name}" if lang else f"resource/{name}", exts, when, message, guard, 1, after, live=True, category=f"resource-{lang or 'c'}", fix_id=fix, **k)


# fixed values: resources that are opened and not closed nearby
RESOURCE = (
    _res("go", "unclosed-file", GO, r"\b(os\.Open|os\.Create|os\.OpenFile)\s*\(", "File opened without defer Close() in nearby lines", r"\bdefer\b", 5, "unclosed-file"),
    _res("go", "unclosed-body", GO, r"\b(http\.Get|http\.Post|http\.Head|http\.PostForm|client\.Do|client\.Get|client\.Post|client\.Head)\s*\(", "HTTP response body not closed; this leaks connections", r"\.Body\.Close\(\)", 5, "unclosed-body"),
    _res("go", "unclosed-rows", GO, r"\b(\.Query|\.QueryContext|\.QueryRow|\.QueryRowContext)\s*\(", "Database rows not closed; this leaks database connections", r"defer\b.*\.(Close|Scan)\(\)|\.Close\(\)", 5, "unclosed-rows", unless=r"QueryRow"),
    _res("go", "unclosed-listener", GO, r"\b(net\.Listen|tls\.Listen|net\.ListenPacket)\s*\(", "Network listener opened without defer Close()", r"\bdefer\b", 5, "missing-defer"),
    _res("go", "unclosed-grpc", GO, r"\b(grpc\.Dial|grpc\.DialContext|grpc\.NewClient)\s*\(", "gRPC connection opened without defer Close()", r"\bdefer\b", 5, "missing-defer"),
    _res("go", "unclosed-db", GO, r"\b(sql\.Open|sqlx\.Open|sqlx\.Connect)\s*\(", "Database connection opened without defer Close()", r"\bdefer\b", 5, "missing-defer"),
    _res("ts", "unclosed-connection", TS, r"new\s+WebSocket\s*\(", "WebSocket created without .close() in nearby code", r"\.close\(", 8, "unclosed-connection"),
    _res("ts", "unclosed-db", TS, r"\b(createConnection|createPool|connect)\s*\(", "Database connection created without cleanup in nearby code", r"\.(close|end|destroy)\(\)", 8, "unclosed-connection"),
    _res("ts", "unclosed-stream", TS, r"\b(createReadStream|createWriteStream)\s*\(", "Stream created without .destroy(), .close(), or .pipe() handling", r"\.(destroy|close|end)\s*\(|\.pipe\(", 8, "unclosed-stream", unless=r"\.pipe\("),
    Guarded("resource/ts-missing-cleanup", TS, r"\.addEventListener\s*\(", "addEventListener without corresponding removeEventListener (potential memory leak)", r"\.removeEventListener\s*\(", hunk=True, category="resource-ts", fix_id="missing-cleanup"),
    Guarded("resource/ts-interval-leak", TS, r"\bsetInterval\s*\(", "setInterval without clearInterval (timer leak)", r"\bclearInterval\s*\(", hunk=True, category="resource-ts", fix_id="missing-cleanup"),
    Guarded("resource/ts-missing-abort-controller", TS, r"\bfetch\s*\(", "fetch() in effect/lifecycle hook without AbortController for cancellation", r"\bAbortController\b", -10, 9, requires=r"\b(useEffect|onMount)\s*\(", category="resource-ts", fix_id="missing-abort-controller"),
    _res("python", "no-context-manager", PY, r"\bopen\s*\(", "File opened without 'with' statement (potential file handle leak)", r"\.close\(\)", 5, "no-context-manager", unless=r"\bwith\b.*\bopen\s*\("),
    _res("python", "unclosed-connection", PY, r"\b(sqlite3\.connect|psycopg2\.connect|pymysql\.connect|MySQLdb\.connect|cx_Oracle\.connect)\s*\(", "Database connection opened without 'with' or .close()", r"\.close\(\)", 5, "unclosed-connection", unless=r"\bwith\b"),
    _res("python", "unclosed-session", PY, r"\brequests\.Session\s*\(", "requests.Session() created without 'with' or .close()", r"\.close\(\)", 5, "unclosed-session", unless=r"\bwith\b"),
    Guarded("resource/rust-leaked-box", RS, r"\bBox::leak\s*\(", "Box::leak() intentionally leaks memory; ensure this is necessary", category="resource-rust", fix_id="leaked-box"),
    Guarded("resource/rust-forget-drop", RS, r"\bmem::forget\s*\(", "mem::forget() suppresses Drop, which can leak resources", category="resource-rust", fix_id="forget-drop"),
    _res("java", "unclosed-resource", JAVA, r"new\s+(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter|FileReader|FileWriter|PrintWriter|Scanner|Socket|ServerSocket)\s*\(|DriverManager\.getConnection\s*\(", "Resource opened without try-with-resources or close()", r"\.close\(\)|\bfinally\s*\{", 10, "unclosed-resource", unless=r"\btry\s*\("),
    _res("", "c-unclosed-file", C, r"\bfopen\s*\(", "fopen() without fclose() in same scope", r"\bfclose\s*\(", 10, "unclosed-file"),
    _res("", "c-malloc-no-free", C, r"\b(malloc|calloc|realloc)\s*\(", "Memory allocated with malloc/calloc without visible free() in nearby code", r"\bfree\s*\(|\breturn\b", 10, "malloc-no-free"),
    _res("", "c-unclosed-socket", C, r"\bsocket\s*\(", "socket() opened without close()/closesocket() in same scope", r"\b(close|closesocket)\s*\(", 10, "unclosed-socket"),
    Guarded("resource/cpp-new-no-delete", (".cpp", ".cc", ".hpp"), r"\bnew\s+\w+", "Raw 'new' without delete or smart pointer", r"\bdelete\b|\b(unique_ptr|shared_ptr|make_unique|make_shared)\b", hunk=True, category="resource-c", fix_id="malloc-no-free"),
    _res("csharp", "missing-using", CS, r"new\s+(FileStream|StreamReader|StreamWriter|SqlConnection|HttpClient|TcpClient|NetworkStream|BinaryReader|BinaryWriter|MemoryStream)\s*\(", "Disposable resource created without 'using' statement or Dispose()", r"\.Dispose\s*\(", 8, "missing-using", unless=r"\busing\s*[\(\s]|\bawait\s+using\b"),
    _res("ruby", "no-block-form", RB, r"\bFile\.open\s*\(", "File.open() without block form (file handle may leak)", r"\.close|do\s*\|", 2, "no-block-form", unless=r"File\.open\s*\([^)]*\)\s*(do\s*\||\{)"),
    Guarded("resource/php-unclosed-handle", PHP, r"\bfopen\s*\(", "fopen() without fclose() in nearby code", r"\bfclose\s*\(", hunk=True, category="resource-php", fix_id="unclosed-handle"),
    Guarded("resource/php-unclosed-pdo", PHP, r"new\s+PDO\s*\(", "PDO connection without explicit null assignment for cleanup", r"= (null|NULL)", hunk=True, category="resource-php", fix_id="unclosed-handle"),
    Guarded("resource/swift-missing-autoreleasepool", SW, r"\b(UIImage|NSImage|Data|NSData|CGImage|CIImage)\s*\(", "Heavy allocation in loop without autoreleasepool", r"\bautoreleasepool\b", hunk=True, requires=r"\bfor\b.*\bin\b", category="resource-swift", fix_id="missing-autoreleasepool"),
    _res("kotlin", "unclosed-resource", KT, r"\b(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter|Socket|ServerSocket)\s*\(", "Resource created without .use { } block or .close()", r"\.use\s*\{|\.close\s*\(", 5, "unclosed-resource", unless=r"\.use\s*\{"),
)


def _con(lang: str, name: str, exts: tuple, when: str, message: str, guard: str = "", before: int = 0, after: int = 0, **k) -> Guarded:
    return Guarded(f"concurrency/{name}", exts, when, message, guard, before, after, category=f"concurrency-{lang}", **k)


# fixed values: concurrent work without its counterpart
CONCURRENCY = (
    _con("go", "goroutine-leak", GO, r"\bgo\s+(func\s*\(|[a-zA-Z_]\w*[\w.]*\()", "Goroutine launched without context.Context — may run forever with no cancellation mechanism", r"\bctx\b|\bcontext\.", 0, 3),
    _con("go", "channel-size-zero", GO, r"\bmake\s*\(\s*chan\s+", "Unbuffered channel — sender and receiver must be ready simultaneously or goroutine may block", unless=r"\bmake\s*\(\s*chan\s+\w+\s*,", severity="info"),
    _con("go", "missing-lock", GO, r"\w+\s*\[[^\]]+\]\s*=", "Map/slice write in scope with goroutine but no visible mutex — potential data race", r"\.\s*(Lock|RLock|Unlock|RUnlock)\s*\(|sync\.(Mutex|RWMutex)", hunk=True, requires=r"\bgo\s+func\s*\("),
    _con("ts", "unhandled-concurrent", TS, r"Promise\.(all|allSettled)\s*\(\s*\[", "Promise.all/allSettled without error handling — if any promise rejects, the error is unhandled", r"\.catch\s*\(|\btry\s*\{", -15, 5),
    _con("ts", "missing-cleanup", TS, r"\bsetInterval\s*\(", "setInterval() without clearInterval() — timer will run indefinitely and may cause memory leaks", r"\bclearInterval\s*\(", hunk=True),
    _con("ts", "missing-cleanup", TS, r"\bsetTimeout\s*\(", "setTimeout() without clearTimeout() — may fire after component unmount causing state updates on unmounted components", r"\bclearTimeout\s*\(", hunk=True, severity="info"),
    _con("python", "missing-join", PY, r"\.start\s*\(\s*\)", "Thread started without .join() — thread may outlive the calling scope", r"\.join\s*\(", hunk=True, requires=r"\bThread\s*\("),
    _con("python", "thread-unsafe-global", PY, r"^[a-zA-Z_]\w*\s*=", "Global variable modified in threaded context without threading.Lock", r"\b(threading\.Lock|Lock)\s*\(", hunk=True, requires=r"target\s*="),
    _con("python", "async-blocking", PY, r"\btime\.sleep\s*\(", "time.sleep() inside async function blocks the event loop", scope=(r"\basync\s+def\b", r"^\s*def ")),
    _con("python", "async-blocking", PY, r"\brequests\.(get|post|put|delete|patch|head)\s*\(", "Blocking HTTP call (requests) inside async function blocks the event loop", scope=(r"\basync\s+def\b", r"^\s*def ")),
    _con("ts", "race-condition", TS, r"\bsetState\s*\(", "Multiple setState calls in async function — may cause race conditions or intermediate renders", needs=((r"\basync\s+", -30, -1, False), (r"\bsetState\s*\(", 1, 10, True))),
    _con("rust", "unsafe-send", RS, r"\bunsafe\s+impl\s+(Send|Sync)\b", "unsafe impl Send/Sync bypasses Rust's thread safety guarantees — extremely dangerous", severity="error"),
    _con("rust", "arc-without-mutex", RS, r"\bArc::new\s*\(", "Arc::new() without Mutex/RwLock — shared ownership without interior mutability protection", r"\b(Mutex|RwLock)::new\s*\(", 0, 2),
    _con("java", "unsynchronized-collection", JAVA, r"\bnew\s+(HashMap|ArrayList|HashSet|LinkedList|TreeMap)\s*[<(]", "Collection is not thread-safe — concurrent access will cause data corruption", r"\bsynchronized\b|\bCollections\.synchronized|\bnew\s+ConcurrentHashMap\s*[<(]", hunk=True, requires=r"\bnew\s+Thread\s*\(|\.(submit|execute)\s*\("),
    _con("java", "double-check-locking", JAVA, r"\bsynchronized\s*\(", "Double-checked locking without volatile — field may be seen in partially-constructed state by other threads", r"\bvolatile\b", hunk=True, requires=r"if\s*\(\s*\w+\s*==\s*null\s*\)", severity="error"),
    _con("c", "missing-join", C, r"\bpthread_create\s*\(", "pthread_create() without pthread_join() or pthread_detach() — thread resources will leak", r"\bpthread_(join|detach)\s*\(", hunk=True),
    _con("c", "data-race", C, r"^static\s+(int|char|float|double|long|unsigned|bool|void\s*\*|struct\s+\w+)\s+\w+\s*[=;]", "Static variable in threaded context without mutex protection — potential data race", r"\bpthread_mutex_(lock|trylock)\s*\(", hunk=True, requires=r"\bpthread_create\s*\(|\bstd::thread\b|\bstd::async\s*\("),
    _con("ruby", "thread-unsafe-instance", RB, r"@[a-zA-Z_]\w*\s*=", "Instance variable modification in threaded context without Mutex — potential race condition", r"\bMutex\.new\b|\.synchronize\b", hunk=True, requires=r"\bThread\.new\b"),
    _con("swift", "actor-violation", SW, r"\bvar\s+\w+", "Mutable state access from async Task context without actor isolation", r"\bactor\b|@MainActor", hunk=True, requires=r"\bTask(\.detached)?\s*\{"),
    _con("kotlin", "global-scope", KT, r"\bGlobalScope\.(launch|async)\b", "GlobalScope.launch/async creates unstructured coroutines that may leak"),
    _con("csharp", "async-void", CS, r"\basync\s+void\b", "async void method — exceptions will crash the process and the method cannot be awaited"),
    _con("scala", "global-exec-context", SCALA, r"\bExecutionContext\.global\b", "Using ExecutionContext.global — shared thread pool may cause thread starvation under load", severity="info"),
    _con("elixir", "unlinked-spawn", EX, r"\bspawn\s*\(", "spawn() without link — crashes in the spawned process will go unnoticed", severity="info", unless=r"\bspawn_link\s*\("),
    _con("elixir", "missing-task-await", EX, r"\bTask\.async\s*\(", "Task.async() without Task.await — result is never collected and errors may be lost", r"\bTask\.await\b", hunk=True),
)


def _err(lang: str, name: str, exts: tuple, when: str, message: str, guard: str = "", before: int = 0, after: int = 0, **k) -> Guarded:
    return Guarded(f"errorhandling/{name}", exts, when, message, guard, before, after, category=f"errorhandling-{lang}" if lang else "errorhandling", **k)


# fixed values: errors that are dropped
ERRORS = (
    _err("go", "go-discarded-error", GO, r"_\s*=\s*\w+[\w.]*\(|_\s*,\s*_\s*=\s*\w+[\w.]*\(", "Discarded error return value"),
    _err("ts", "ts-unhandled-promise", TS, r"\.then\s*\(", "Promise chain with .then() but no .catch() handler", unless=r"\.catch\s*\(", chain=(r"\.catch\s*\(", r"^\s*[^\s.)]", 5)),
    _err("ts", "ts-unhandled-await", TS, r"\bawait\s+", "await expression without try-catch block", r"try.*\{|^\s*try\s*$", -20, -1),
    _err("python", "python-bare-except", PY, r"^\s*except\s*:", "Bare except clause catches all exceptions including KeyboardInterrupt and SystemExit"),
    _err("python", "python-except-pass", PY, r"^\s*except\s+(Exception|BaseException)\s*(as\s+\w+)?\s*:", "Broad exception caught and silently ignored with pass", needs=((r"^\s*pass\s*$", 1, 1, True),)),
    _err("java", "java-empty-catch", JAVA, r"catch\s*\([^)]+\)\s*\{\s*\}", "Empty catch block silently swallows exception"),
    _err("java", "java-broad-catch", JAVA, r"catch\s*\(\s*Exception\s+\w+\s*\)", "Catching overly broad Exception type", severity="info"),
    _err("java", "java-broad-throws", JAVA, r"throws\s+Exception\b", "Method declares overly broad 'throws Exception'", severity="info"),
    _err("rust", "rust-unwrap", RS, r"\.unwrap\(\)", "Use of .unwrap() will panic on None/Err values"),
    _err("rust", "rust-generic-expect", RS, r'\.expect\(\s*"(?i)(failed|error|unexpected|something went wrong|unwrap failed|should not fail)', "Generic .expect() message provides little debugging context", severity="info"),
    _err("", "unchecked-alloc", C, r"\b(malloc|calloc|realloc)\s*\(", "Memory allocation without NULL check", r"\bif\s*\(\s*\w+\s*[!=]=\s*NULL|\bif\s*\(\s*!\s*\w+\s*\)", 1, 3),
    _err("", "unchecked-fopen", C, r"\bfopen\s*\(", "fopen() without NULL check", r"\bif\s*\(\s*\w+\s*[!=]=\s*NULL|\bif\s*\(\s*!\s*\w+\s*\)", 1, 3),
    _err("", "empty-catch", DART, r"\bcatch\s*\([^)]*\)\s*\{\s*\}", "Empty catch block swallows errors silently"),
    _err("", "broad-catch", DART, r"\bon\s+Exception\s+catch", "Catching broad 'Exception' type hides specific errors"),
    _err("", "bare-rescue", EX, r"\brescue\s*$|\brescue\s+_\s*->", "Bare rescue hides specific errors"),
    _err("", "empty-catch", SCALA, r"\bcatch\s*\{\s*\}", "Empty catch block swallows exceptions", marks=SLASH),
    _err("", "catch-all", SCALA, r"case\s+_\s*:\s*Throwable\s*=>|case\s+_\s*=>", "Catching all exceptions with wildcard pattern", scope=(r"catch[^}]*\{[^}]*$", r"\}"), marks=SLASH),
    _err("", "catch-unreachable", (".zig",), r"\bcatch\s+unreachable\b", "catch unreachable will crash if the error actually occurs", marks=SLASH),
    _err("", "panic", (".zig",), r"@panic\s*\(", "@panic() will crash the program — use error returns instead", marks=SLASH),
    _err("", "bare-except", (".nim",), r"\bexcept\s*:", "Bare except: catches all exceptions including system exceptions", marks=HASH),
    _err("", "empty-rescue", (".cr",), r"rescue\s*$", "Empty rescue block catches all exceptions silently", marks=HASH),
    _err("", "broad-rescue", (".cr",), r"rescue\s+Exception\b", "Rescuing Exception is too broad — catches system exceptions too", marks=HASH),
    _err("", "or-panic", (".v",), r"or\s*\{\s*panic\s*\(", "or { panic(err) } crashes on error instead of handling it", marks=SLASH),
    _err("", "empty-or-block", (".v",), r"or\s*\{\s*\}", "Empty or {} block silently swallows errors", marks=SLASH),
    _err("", "empty-catch", (".d",), r"\bcatch\s*\([^)]*\)\s*\{\s*\}", "Empty catch block swallows exceptions silently", marks=r"^\s*(//|/\*|/\+)"),
    _err("", "haskell-fromjust", (".hs", ".lhs"), r"\bfromJust\b", "fromJust crashes on Nothing", marks=DASHES),
    _err("", "haskell-error", (".hs", ".lhs"), r"\berror\s+\"", "error throws an exception that terminates the program", marks=DASHES),
    _err("", "haskell-undefined", (".hs", ".lhs"), r"\bundefined\b", "undefined will crash at runtime", marks=DASHES, severity="error"),
    _err("", "clojure-catch-all", (".clj", ".cljs", ".cljc"), r"\(catch\s+Exception\s", "Catching broad Exception type hides specific errors", marks=r"^\s*;"),
    _err("", "erlang-catch-all", (".erl", ".hrl"), r"catch\s+_\s*->", "Catch-all clause swallows all errors", marks=r"^\s*%"),
    _err("", "fsharp-failwith", (".fs", ".fsx"), r"\bfailwith\b", "failwith throws an exception", marks=SLASH),
    _err("", "ocaml-catch-all", (".ml", ".mli"), r"with\s+_\s*->", "Wildcard exception handler catches all exceptions", marks=r"^\s*\(\*"),
    _err("", "perl-die-no-message", (".pl", ".pm"), r"\bdie\s*;", "die without message provides no diagnostic info", marks=HASH),
    _err("", "powershell-silently-continue", (".ps1", ".psm1"), r"(?i)-ErrorAction\s+SilentlyContinue", "SilentlyContinue suppresses errors", marks=HASH),
    _err("", "groovy-catch-all", (".groovy", ".gvy"), r"catch\s*\(\s*Exception\s", "Catching broad Exception type hides specific errors", marks=SLASH),
    _err("", "julia-catch-all", (".jl",), r"\bcatch\s+\w+\s*$", "Broad catch clause may hide errors", marks=HASH),
    _err("", "solidity-require-no-message", (".sol",), r"\brequire\s*\([^,)]+\)\s*;", "require() without error message provides poor debugging", marks=SLASH, severity="info"),
    _err("", "vb-empty-catch", (".vb", ".vbs"), r"(?i)^\s*Catch\b", "Catch without exception type catches all exceptions", unless=r"(?i) as | when ", marks=r"^\s*'"),
    _err("", "ada-when-others", (".adb", ".ads"), r"(?i)\bwhen\s+others\s*=>", "'when others' catches all exceptions", marks=DASHES, severity="info"),
    _err("", "pascal-bare-except", (".pas", ".pp"), r"(?i)^\s*except\s*$", "Bare 'except' catches all exceptions", marks=r"^\s*(//|\{)"),
)
ALL = (*RESOURCE, *CONCURRENCY, *ERRORS)
