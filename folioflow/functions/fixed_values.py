"""The term tables, patterns, markers and prompts whose exact wording decides results."""

from __future__ import annotations

# English terms that stay English.
KEEP_ENGLISH = (
    'software architect',
    'software architecture',
    'software engineering',
    'software developer',
    'software development',
    'API',
    'REST',
    'GraphQL',
    'gRPC',
    'HTTP',
    'HTTPS',
    'TCP',
    'UDP',
    'Docker',
    'Kubernetes',
    'CI/CD',
    'DevOps',
    'GitOps',
    'SQL',
    'NoSQL',
    'MongoDB',
    'PostgreSQL',
    'Redis',
    'Kafka',
    'AWS',
    'GCP',
    'Azure',
    'SaaS',
    'PaaS',
    'IaaS',
    'microservices',
    'monolith',
    'event-driven',
    'pipeline',
    'SOLID',
    'DDD',
    'TDD',
    'BDD',
    'ADR',
    'SLA',
    'SLO',
    'SLI',
    'RTO',
    'RPO',
)

# English to Ukrainian glossary.
GLOSSARY = {
    'architect': 'архітектор',
    'developer': 'розробник',
    'stakeholder': 'зацікавлена сторона',
    'stakeholders': 'зацікавлені сторони',
    'architecture characteristics': 'архітектурні характеристики',
    'architecture characteristic': 'архітектурна характеристика',
    'architectural quantum': 'архітектурний квант',
    'architectural quanta': 'архітектурні кванти',
    'fitness function': 'фітнес-функція',
    'fitness functions': 'фітнес-функції',
    'bounded context': 'обмежений контекст',
    'bounded contexts': 'обмежені контексти',
    'component': 'компонент',
    'components': 'компоненти',
    'deployment unit': 'одиниця розгортання',
    'scalability': 'масштабованість',
    'availability': 'доступність',
    'reliability': 'надійність',
    'maintainability': 'зручність супроводу',
    'testability': 'тестованість',
    'deployability': 'придатність до розгортання',
    'agility': 'гнучкість',
    'elasticity': 'еластичність',
    'performance': 'продуктивність',
    'security': 'безпека',
    'observability': 'спостережуваність',
    'fault tolerance': 'відмовостійкість',
    'recoverability': 'відновлюваність',
    'coupling': "зв'язаність",
    'cohesion': 'зчепленість',
    'modularity': 'модульність',
    'abstraction': 'абстракція',
    'encapsulation': 'інкапсуляція',
    'connascence': 'конасценція',
    'afferent coupling': "доцентрова зв'язаність",
    'efferent coupling': "відцентрова зв'язаність",
    'abstractness': 'абстрактність',
    'instability': 'нестабільність',
    'distance from the main sequence': 'відстань від головної послідовності',
    'layered architecture': 'шарувата архітектура',
    'microkernel architecture': 'мікроядерна архітектура',
    'service-based architecture': 'сервісно-орієнтована архітектура',
    'event-driven architecture': 'подієво-орієнтована архітектура',
    'space-based architecture': 'просторово-орієнтована архітектура',
    'pipeline architecture': 'конвеєрна архітектура',
    'orchestration-driven service-oriented architecture': 'оркестраційно-керована сервісно-орієнтована архітектура',
    'microservices architecture': 'мікросервісна архітектура',
    'big ball of mud': 'великий клубок бруду',
    'trade-off': 'компроміс',
    'trade-offs': 'компроміси',
    'anti-pattern': 'антипатерн',
    'anti-patterns': 'антипатерни',
    'design pattern': 'патерн проєктування',
    'design patterns': 'патерни проєктування',
    'broker topology': 'топологія брокера',
    'mediator topology': 'топологія медіатора',
    'orchestration': 'оркестрація',
    'choreography': 'хореографія',
    'saga': 'сага',
    'sagas': 'саги',
    'continuous delivery': 'безперервне постачання',
    'continuous integration': 'безперервна інтеграція',
    'continuous deployment': 'безперервне розгортання',
    'refactoring': 'рефакторинг',
    'technical debt': 'технічний борг',
    'code review': 'перегляд коду',
    'pull request': 'запит на злиття',
    'architecture decision record': 'запис архітектурного рішення',
    'architecture decision records': 'записи архітектурних рішень',
    'risk assessment': 'оцінка ризиків',
    'risk matrix': 'матриця ризиків',
    'risk storming': 'штурм ризиків',
    'agile': 'гнучка методологія (Agile)',
    'scrum': 'Scrum',
    'team topology': 'топологія команди',
    'domain-driven design': 'предметно-орієнтоване проєктування (DDD)',
    'extreme programming': 'екстремальне програмування (XP)',
}

# Ukrainian terms that are annotated with their English original, in table order.
ANNOTATIONS = {
    "зв'язаність": 'coupling',
    'зчепленість': 'cohesion',
    'модульність': 'modularity',
    'абстракція': 'abstraction',
    'абстрактність': 'abstractness',
    'нестабільність': 'instability',
    'конасценція': 'connascence',
    "доцентрова зв'язаність": 'afferent coupling',
    "відцентрова зв'язаність": 'efferent coupling',
    'архітектурні характеристики': 'architecture characteristics',
    'архітектурна характеристика': 'architecture characteristic',
    'архітектурний квант': 'architecture quantum',
    'фітнес-функція': 'fitness function',
    'обмежений контекст': 'bounded context',
    'масштабованість': 'scalability',
    'доступність': 'availability',
    'надійність': 'reliability',
    'зручність супроводу': 'maintainability',
    'тестованість': 'testability',
    'придатність до розгортання': 'deployability',
    'еластичність': 'elasticity',
    'продуктивність': 'performance',
    'спостережуваність': 'observability',
    'відмовостійкість': 'fault tolerance',
    'відновлюваність': 'recoverability',
    'шарувата архітектура': 'layered architecture',
    'мікроядерна архітектура': 'microkernel architecture',
    'конвеєрна архітектура': 'pipeline architecture',
    'мікросервісна архітектура': 'microservices architecture',
    'мікросервіси': 'microservices',
    'великий клубок бруду': 'big ball of mud',
    'антипатерн': 'anti-pattern',
    'антипатерни': 'anti-patterns',
    'запис архітектурного рішення': 'ADR',
    'штурм ризиків': 'risk storming',
    'матриця ризиків': 'risk matrix',
    'безперервне постачання': 'continuous delivery',
    'безперервна інтеграція': 'continuous integration',
    'безперервне розгортання': 'continuous deployment',
    'технічний борг': 'technical debt',
    'рефакторинг': 'refactoring',
    'оркестрація': 'orchestration',
    'хореографія': 'choreography',
    'сага': 'saga',
    'компроміс': 'trade-off',
}

# Ordered patterns (case-insensitive) and the English that replaces them.
ENGLISH_FORMS = (
    (r'архітектор[аиуові]?\s+програмного\s+забезпечення', 'software architect'),
    (r'архітектор[аиуові]?\s+програмне\s+забезпечення', 'software architect'),
    (r'архітектур[аиуові]+\s+програмного\s+забезпечення', 'software architecture'),
    (r'програмн[аиоу]+\s+архітектур[аиуові]*', 'software architecture'),
    (r'програмн[аиоу]+\s+архітектор[аиуові]*', 'software architect'),
    (r'інженерія\s+програмного\s+забезпечення', 'software engineering'),
    (r'розробк[аи]\s+програмного\s+забезпечення', 'software development'),
    (r'безперервн[аіе]\s+інтеграці[яї]', 'CI'),
    (r'безперервн[аіе]\s+постачанн[яі]', 'CD'),
    (r'безперервн[аіе]\s+розгортанн[яі]', 'CD'),
    (r'дев\s*опс', 'DevOps'),
    (r'докер(?!\w)', 'Docker'),
    (r'кубернетес', 'Kubernetes'),
    (r'кубернетс(?!\w)', 'Kubernetes'),
    (r'гіт\s*хаб', 'GitHub'),
    (r'гітхаб', 'GitHub'),
    (r'гіт\s*лаб', 'GitLab'),
    (r'гітлаб', 'GitLab'),
    (r'програмний\s+інтерфейс\s+застосунку', 'API'),
    (r'прикладний\s+програмний\s+інтерфейс', 'API'),
    (r'інтерфейс\s+програмування\s+застосунків', 'API'),
    (r'передача\s+репрезентативного\s+стану', 'REST'),
    (r'репрезентативна\s+передача\s+стану', 'REST'),
    (r'граф\s*ql', 'GraphQL'),
    (r'г-?рпц', 'gRPC'),
    (r'амазон\s+веб[\s-]сервіси', 'AWS'),
    (r'гугл\s+хмарна\s+платформа', 'GCP'),
    (r'гугл\s+клауд', 'Google Cloud'),
    (r'майкрософт\s+азур', 'Azure'),
    (r'мікрософт\s+азур', 'Azure'),
    (r'мікросервісн[аиу]+\s+архітектур[аиуові]*', 'microservices architecture'),
    (r'мікросервіс[аиуові]*(?!\s+архітектур)', 'microservices'),
    (r'монолітн[аиу]+\s+архітектур[аиуові]*', 'monolithic architecture'),
    (r'подієво[\s-]керован[аиу]+\s+архітектур[аиуові]*', 'event-driven architecture'),
    (r'подієво[\s-]керован[аиу]+', 'event-driven'),
    (r'структурована\s+мова\s+запитів', 'SQL'),
    (r'нереляційн[аиу]+\s+баз[аи]\s+даних', 'NoSQL database'),
    (r'розробка\s+(?:через|на\s+основі)\s+тестування', 'TDD'),
    (r'тест[\s-]орієнтована\s+розробка', 'TDD'),
    (r'предметно[\s-]орієнтоване\s+проєктування', 'DDD'),
    (r'гнучк[аиу]+\s+методологі[яї]', 'Agile'),
    (r'гнучк[аиу]+\s+розробк[аи]', 'Agile development'),
    (r'скрам(?!\w)', 'Scrum'),
)

# The prompts.
SYSTEM_PROMPT = """Ти — перекладач технічної книги. Перекладай текст з англійської на українську.

СУВОРІ ПРАВИЛА:
1. Виводь ТІЛЬКИ переклад наданого тексту — нічого більше
2. НЕ додавай власного контенту: без прикладів, висновків, підсумків, нових розділів
3. НЕ повторюй оригінал і НЕ показуй двомовний текст
4. НЕ додавай мітки типу [Переклад українською], [Продовження] або (Продовження тексту...)
5. Зберігай структуру Markdown: # ## ### * ** `код` — структуру абзаців оригіналу
6. Блоки коду ``` залишай БЕЗ ЗМІН — не перекладай, не додавай нові ```
7. НЕ додавай ``` навколо звичайного тексту — лише якщо в оригіналі є ```
8. Математичні формули — зберігай точно як в оригіналі, не перекладай символи
9. ЗАЛИШАЙ англійською: API, REST, GraphQL, gRPC, Docker, Kubernetes, CI/CD, DevOps, SOLID, DDD, TDD, ADR, SLA, SQL, NoSQL, AWS, GCP, Azure, software architect, software architecture, software engineering
10. Не перекладай: власні назви, назви компаній, інструментів, акроніми
11. Приклади з назвами методів/класів у псевдокоді (add customer, get customer, OrderStrategy тощо) — залишай англійською
12. Стиль: академічна українська, чітка і зрозуміла
13. Числа, URL, email — без змін"""

TERM_FIX_PROMPT = """Ти — редактор технічного перекладу. Тобі дано оригінальний англійський текст і його переклад на українську.

Твоє завдання: знайди технічні терміни в оригіналі, які **потрібно залишати англійською** (CamelCase назви, абревіатури, назви фреймворків/бібліотек/інструментів, власні назви продуктів), але які були неправильно перекладені.

Поверни ТІЛЬКИ виправлений Ukrainian текст. Без пояснень, без коментарів.
Якщо виправлень немає — поверни текст без змін."""

CONTEXT_LABEL = "[Попередній контекст для узгодженості термінології]:"
SOURCE_LABEL = "[Текст для перекладу]:"
ANSWER_LABEL = "[Переклад українською]:"
FIX_LABELS = ("[Оригінал (англійська)]:", "[Переклад (до виправлення)]:", "[Виправлений переклад]:")

# Strings that betray an answer with added content.
MARKERS = ("[Переклад українською]", "[Продовження тексту", "(Продовження тексту не надається")
FAKE_SECTIONS = (
    "Приклади використання", "Висновки\n", "Стратегії подолання", "Класифікація ", "Популярні архітектурні",
    "Розробка та реалізація архітектури\n", "Переваги та недоліки\n", "Практичні поради\n",
)

# Formats of the assembled book.
CHUNK_SEPARATOR = "\n\n---\n\n"
GLOSSARY_TITLE = "## Глосарій технічних термінів\n"
GLOSSARY_HEAD = ("| Англійський термін | Українське значення |", "|---|---|")
HEADER = "# {title}\n\n> Переклад: сторінки {start}–{end} з {total}\n\n---\n\n"
IMAGE_WORD = "Рисунок"
