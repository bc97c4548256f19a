"""Fixed values that results depend on: languages, roles, layers, words, thresholds, the ontology."""

# File name extensions of each language, in the order in which they are tried.
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "java": ["java"],
    "csharp": ["cs"],
    "python": ["py"],
    "go": ["go"],
    "rust": ["rs"],
    "cpp": ["cpp", "cc", "cxx", "c", "hpp", "h", "hxx"],
    "sql": ["sql"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "markdown": ["md", "mdx", "markdown"],
}

# What a lower-case path contains, and the role that shows; the first that holds counts.
# "-x" excludes, "$x" is the end of the path, "~x" a pattern.
ROLES = {
    "typescript": [
        ("controller", ["controller"]),
        ("service", ["service", "-.test", "-.spec"]),
        ("repository", ["repository", "repo"]),
        ("model", ["model", "entity"]),
        ("dto", ["dto"]),
        ("middleware", ["middleware"]),
        ("guard", ["guard"]),
        ("interceptor", ["interceptor"]),
        ("pipe", ["pipe"]),
        ("filter", ["filter"]),
        ("handler", ["handler"]),
        ("resolver", ["resolver"]),
        ("gateway", ["gateway"]),
        ("factory", ["factory"]),
        ("module", ["module"]),
        ("component", ["component", "$.tsx", "$.jsx"]),
        ("hook", ["hook", "~/use[A-Za-z0-9_]+"]),
        ("store", ["store", "redux", "zustand"]),
        ("action", ["action"]),
        ("reducer", ["reducer"]),
        ("saga", ["saga"]),
        ("effect", ["effect"]),
        ("utility", ["util", "helper"]),
        ("configuration", ["config"]),
        ("migration", ["migration"]),
        ("test", [".test", ".spec", "__test"]),
        ("test-fixture", ["fixture", "mock"]),
    ],
    "java": [("controller", ["controller"]), ("service", ["service", "-test"]), ("repository", ["repository", "dao"]), ("model", ["model", "entity"]), ("dto", ["dto"]), ("handler", ["handler"]), ("filter", ["filter"]), ("configuration", ["config"]), ("test", ["test"])],
    "csharp": [("controller", ["controller"]), ("service", ["service"]), ("repository", ["repository"]), ("model", ["model", "entity"]), ("dto", ["dto"]), ("gateway", ["hub"]), ("middleware", ["middleware"]), ("test", ["test"])],
    "python": [("controller", ["views", "controller", "router"]), ("service", ["service"]), ("repository", ["repository", "dao"]), ("model", ["model", "schema"]), ("dto", ["serializer"]), ("middleware", ["middleware"]), ("test", ["test"])],
    "go": [("controller", ["handler", "controller"]), ("service", ["service"]), ("repository", ["repository", "store"]), ("model", ["model"]), ("middleware", ["middleware"]), ("test", ["_test.go"])],
    "rust": [("controller", ["handler", "routes"]), ("service", ["service"]), ("repository", ["repository", "db"]), ("model", ["model", "schema"]), ("test", ["test"])],
    "cpp": [("service", ["service"]), ("model", ["model", "entity"]), ("test", ["test"]), ("utility", ["util", "helper"])],
}
ROLES["javascript"] = ROLES["typescript"]

# What a lower-case path contains, and the layer that shows; the first that holds counts.
LAYERS = [
    ("test", ["/test/", "/tests/", "/__tests__/", ".test.", ".spec.", "_test."]),
    ("build", ["/build/", "/dist/", "/deploy/", "dockerfile", "docker-compose", ".github/", "jenkinsfile"]),
    ("presentation", ["/ui/", "/frontend/", "/client/", "/pages/", "/views/", "/components/", "/screens/", "$.tsx", "$.jsx"]),
    ("api", ["/api/", "/routes/", "/endpoints/", "/controllers/", "controller."]),
    ("business-logic", ["/services/", "/domain/", "/business/", "/logic/", "/core/", "service."]),
    ("data-access", ["/data/", "/repositories/", "/repo/", "/models/", "/entities/", "/database/", "/migrations/", "/schema/", "/dao/", "repository.", "$.sql"]),
    ("infrastructure", ["/infrastructure/", "/infra/", "/config/", "/middleware/", "/interceptors/"]),
    ("shared", ["/shared/", "/common/", "/utils/", "/helpers/", "/lib/"]),
]

# Top directories under which a module path has three parts.
MODULE_TOPS = ["src", "app", "lib", "packages"]

# Manifests, and the kind of project each marks.
MANIFESTS = [
    ("package.json", "npm"),
    ("pom.xml", "maven"),
    ("build.gradle", "gradle"),
    ("build.gradle.kts", "gradle"),
    ("*.csproj", "dotnet"),
    ("*.sln", "dotnet"),
    ("go.mod", "go-module"),
    ("Cargo.toml", "cargo"),
    ("CMakeLists.txt", "cmake"),
    ("requirements.txt", "pip"),
    ("setup.py", "pip"),
    ("pyproject.toml", "pip"),
]

# Words that are no search terms.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can to of in for on with at by from as into through and but or not this that these those it its we they you"
).split()

# Concepts and the words that stand for them.
CONCEPTS = {
    "auth": "authentication authorization login logout signin signout session jwt token oauth credential password guard security mfa".split(),
    "user": "account profile member customer identity principal tenant user".split(),
    "billing": "payment invoice checkout subscription price plan charge refund transaction stripe billing".split(),
    "database": "repository dao store entity model schema table migration sql query postgres mysql sqlite mongo orm".split(),
    "api": "route endpoint controller handler rest graphql grpc http request response payload router".split(),
    "order": "checkout cart purchase item fulfillment shipment delivery receipt order".split(),
    "schedule": "cron job timer periodic interval scheduler task queue delayed worker".split(),
    "cache": "redis memcached memory ttl store invalidation cached caching".split(),
    "audit": "staleness log trail telemetry trace history event record logging".split(),
    "test": "spec unit e2e integration scenario mock stub fixture assertion test".split(),
    "config": "settings env flag featureflag properties options manifest configuration".split(),
}

# Patterns each of whose matches adds one to the complexity of a text.
BRANCHES = [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bdo\s*\{", r"\bcase\s+", r"\bcatch\s*\(", r"\?\s*[^:]", r"&&", r"\|\|", r"\?\?"]

# Ranks of how sure an edge is, the best first; each with the least confidence.
RESOLUTIONS = [("confirmed", 0.9), ("resolved", 0.7), ("heuristic", 0.5), ("unresolved", 0.0)]

# Hierarchy level of each node type.
LEVELS = {
    "repository": 1, "project": 2, "application": 3, "service": 3, "docker-service": 3, "module": 4, "external-dependency": 4, "component": 5, "api-endpoint": 5,
    "test-suite": 5, "database-table": 5, "file": 6, "configuration": 6, "documentation": 6, "symbol": 7, "concept": 8,
}

# Node types that may contain each node type.
PARENTS = {
    "repository": [], "project": ["repository"], "application": ["repository", "project"], "service": ["repository", "project"],
    "module": ["repository", "project", "application", "service", "module"], "component": ["file", "module"], "file": ["repository", "project", "module"], "symbol": ["component", "file"],
    "concept": [], "api-endpoint": ["file", "service", "module", "component"], "test-suite": ["project", "module", "file"], "configuration": ["repository", "project", "file"],
    "external-dependency": ["project"], "database-table": ["file", "module"], "docker-service": ["file", "repository"], "documentation": ["repository", "file"],
}

# Node types that each edge type may lead from and to.
RELATIONS = {
    "contains": ("repository project application service module file component", "project application service module file component symbol api-endpoint test-suite database-table docker-service documentation"),
    "defined-in": ("file component", "symbol component database-table"),
    "imports": ("file module", "file module external-dependency"),
    "depends-on": ("component service module file docker-service database-table", "component service module file external-dependency docker-service database-table"),
    "uses-package": ("project file module", "external-dependency"),
    "implements": ("component symbol", "component symbol"),
    "extends": ("component symbol", "component symbol"),
    "type-reference": ("symbol component", "component symbol"),
    "calls": ("symbol component", "symbol component"),
    "instantiates": ("symbol component", "component"),
    "api-flow": ("api-endpoint", "component symbol service"),
    "handles-route": ("component symbol", "api-endpoint"),
    "consumes-api": ("component service application", "api-endpoint"),
    "communicates-with": ("service docker-service", "service docker-service"),
    "publishes-event": ("component service", "concept component service"),
    "subscribes-event": ("component service", "concept component service"),
    "data-flow": ("component symbol database-table", "component symbol database-table"),
    "reads-from": ("component symbol service", "database-table configuration"),
    "writes-to": ("component symbol service", "database-table configuration"),
    "maps-to": ("component symbol", "database-table component"),
    "configures": ("configuration file", "service project component module"),
    "feature-flag": ("configuration", "component api-endpoint symbol"),
    "tests": ("test-suite file", "component symbol api-endpoint module file"),
    "test-fixture": ("test-suite", "file component database-table"),
    "related-concept": ("concept", "concept"),
    "belongs-to-concept": ("component symbol file api-endpoint database-table", "concept"),
    "layer-boundary": ("module file component", "module file component"),
    "module-boundary": ("module file", "module file"),
}

# Layers that each layer may depend on; test and unknown may depend on all.
LAYER_RULES = {
    "presentation": "presentation api business-logic shared infrastructure unknown".split(),
    "api": "api business-logic shared infrastructure unknown".split(),
    "business-logic": "business-logic data-access shared infrastructure unknown".split(),
    "data-access": "data-access shared infrastructure unknown".split(),
    "infrastructure": "infrastructure shared unknown".split(),
    "shared": "shared unknown".split(),
    "build": "build deployment shared unknown".split(),
    "deployment": "deployment build infrastructure unknown".split(),
}
