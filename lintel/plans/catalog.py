"""The rule catalogue: descriptors, the default profile and the texts of findings.

Fixed values, in their natural order: ids, severities, names, descriptions and
message texts are what findings are compared by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Descriptor:
    id: str
    severity: str
    name: str
    description: str
    route: str = "all"
    default: bool = False
    abstract: bool = False
    version: str = "1.0"
    category: str = "policy"
    scope: str = "line"
    cost: str = "light"


#: The flags of a line that route it to a rule of the route "tokens"; any of them does.
ROUTES = {
    "GX.1.1": ("has_ampersand",),
    "GX.1.4.1": ("has_equal", "has_ampersand"),
    "GX.1.4.2": ("has_if", "has_case"),
    "GX.1.5": ("has_if", "has_case"),
    "GX.2.7.2": ("has_equal", "has_ampersand"),
    "GX.2.7.3": ("has_equal", "has_ampersand"),
    "GX.2.7.4": ("has_ampersand",),
}

E, W = "ERROR", "WARNING"
RULES = (
    Descriptor("GX.1", W, "Código de programas fuentes - Advertencias", "Clase estructural para agrupar jerárquicamente las reglas GX.1.x.", abstract=True),
    Descriptor("GX.1.1", W, "Uso de Mayúsculas y Minúsculas", "Usar Mayúsculas y Minúsculas en uso de variables, variable empieza con &.", "tokens"),
    Descriptor("GX.1.2", W, "Indentar código", "Indentar línea de código en uso de For each, If Then Else, Case."),
    Descriptor("GX.1.3", W, "Sintaxis de Sentencias particulares", "Se debe indicar el índice que se está recorriendo en el For Each. También al finalizar el recorrido indicar el nombre de la tabla. Uso obligatorio la sentencia del DEFINED BY al final del Where.", default=True),
    Descriptor("GX.1.3.1", W, "For Each", "Se debe indentar el For Each en cada Where y en el cuerpo de código."),
    Descriptor("GX.1.3.2", W, "If", "Condiciones If debe estar completo con su Else.", default=True),
    Descriptor("GX.1.3.3", W, "Case", "Condiciones Case debe estar completo con su Otherwise.", default=True),
    Descriptor("GX.1.4", W, "Variables", "Clase estructural para agrupar las reglas de la sección 1.4.", abstract=True),
    Descriptor("GX.1.4.1", W, "Concepto de Variables", "No se deben reutilizar variables en distintas partes del código.", "tokens"),
    Descriptor("GX.1.4.2", W, "Definición", "En sentencias de decisión (If, Case) se debe usar variables, no debe usarse atributos.", "tokens"),
    Descriptor("GX.1.4.3", W, "Parámetros", "Definir cada parámetro si es de entrada o de salida, en la sección rule.", default=True),
    Descriptor("GX.1.5", W, "Condiciones Booleanas", "No es recomendable definir condiciones booleanas con más de tres operandos.", "tokens", True),
    Descriptor("GX.1.6", W, "Comentarios", "Clase estructural para agrupar las reglas de la sección 1.6.", abstract=True),
    Descriptor("GX.1.6.1", W, "Comentario en el llamado a Sub Rutinas", "Antes del llamado con DO poner un comentario."),
    Descriptor("GX.1.6.2", W, "Describir la Sub Rutina", "En la subrutina Sub en la siguiente fila poner un Comentario de Descripción."),
    Descriptor("GX.1.7", W, "Modificaciones/Mantenimiento del programa", "Clase estructural para agrupar las reglas de la sección 1.7.", abstract=True),
    Descriptor("GX.1.7.1", W, "Historia de Cambios", "En la sección Rules poner: CODIGO INICIATIVA, DESCRIPCION, RESPONSIBLE, VERSION."),
    Descriptor("GX.1.7.2", W, "Comentario sobre cambios en filas", "Cuando se comente una fila con // poner al final un comentario explicativo.", default=True),
    Descriptor("GX.2.0", E, "Mejores Prácticas - Errores", "Clase estructural para agrupar jerárquicamente las reglas críticas de la sección 2.", abstract=True),
    Descriptor("GX.2.1", E, "Evitar uso de When dentro de cláusulas Where", "Se debe evitar usar clausula When dentro del condicional Where.", default=True),
    Descriptor("GX.2.2", E, "Evitar palabras de condiciones In, Or o And dentro de cláusulas Where", "Evitar In, Or, And dentro del Where.", default=True),
    Descriptor("GX.2.3", E, "For Each anidados", "Evitar For Each / End For solo se permite dos anidaciones.", default=True),
    Descriptor("GX.2.4", E, "No usar funciones en los comandos Where", "No usar funciones dentro de clausula Where.", default=True),
    Descriptor("GX.2.5", E, "Variables con código en duro", "No Asignar variables en código duro dentro del Where.", default=True),
    Descriptor("GX.2.6", E, "Subrutinas", "Se debe iniciar siempre la variable de salida y una buena práctica es con la palabra clave 'nullvalue'.", default=True),
    Descriptor("GX.2.7", E, "Iteración y contadores de Variables", "Clase estructural para agrupar las reglas de la sección 2.7.", abstract=True),
    Descriptor("GX.2.7.1", E, "Iteraciones", "Evitar Variables sueltas i, j y k en las iteraciones.", default=True),
    Descriptor("GX.2.7.2", E, "Contadores", "Evitar Variables sueltas i, j y k en los contadores.", "tokens", True),
    Descriptor("GX.2.7.3", E, "Condición", "Para el caso de la variable condición se recomienda evitar la reutilización.", "tokens", True),
    Descriptor("GX.2.7.4", E, "Variables no usadas", "NO se deben definir variables ni vectores que no se utilicen dentro del programa.", "tokens"),
    Descriptor("GX.2.7.5", W, "Variable escrita sin lectura", "Se asigna una variable y se sobrescribe sin leerla: la primera asignación es innecesaria.", "object", scope="object", cost="moderate"),
    Descriptor("GX.SEC.1", E, "Credenciales en código", "Credenciales o secretos embebidos en literales (CWE-798).", "object", category="security", scope="object", cost="moderate"),
    Descriptor("GX.SEC.2", E, "Dataflow inseguro (SQL/comando/archivo/salida)", "Valor de entrada externa alcanza un sink peligroso sin sanitizador modelado.", "object", category="security", scope="object", cost="deep"),
    Descriptor("GX.SEC.3", E, "Taint interprocedural project-wide", "Valor externo atraviesa llamadas entre objetos y alcanza un sink sin sanitizador modelado.", "project", category="security", scope="project", cost="deep"),
)
BY_ID = {r.id: r for r in RULES}
ORDER = {r.id: i for i, r in enumerate(RULES)}
CONCRETE = tuple(r.id for r in RULES if not r.abstract)
DEFAULT = tuple(r.id for r in RULES if r.default)

#: Message texts; %s and %d are filled in order.
MESSAGES = {
    "GX.1.1": "Variable(s) %s debe(n) empezar con Mayúscula (PascalCase, ej: &MyVariable).",
    "GX.1.2": "Indentación incorrecta: se esperaban al menos %d espacios (nivel %d), se encontraron %d.",
    "GX.1.3/open": "Se debe indicar el índice o tabla que se está recorriendo en la apertura del For Each.",
    "GX.1.3/close": "Al finalizar el For Each (endfor) se debe indicar el nombre de la tabla o un comentario aclaratorio (ej: endfor // Customer).",
    "GX.1.3/where": "Uso obligatorio de la sentencia DEFINED BY al final del Where para el For Each de la línea %d.",
    "GX.1.3.1/where": "La cláusula Where de un For Each debe estar indentada (mínimo 4 espacios).",
    "GX.1.3.1/body": "El cuerpo de código dentro de un For Each debe estar indentado (mínimo 4 espacios).",
    "GX.1.3.2": "La condición IF en la línea %d debe estar completa con su ELSE.",
    "GX.1.3.3": "La estructura CASE en la línea %d debe estar completa con su OTHERWISE.",
    "GX.1.4.1": "Posible reutilización incorrecta de contexto de la variable '&%s' (previamente asignada en la línea %d). Se sugiere definir una nueva variable independiente.",
    "GX.1.4.2": "En sentencias de decisión se deben usar variables locales, no atributos directos de tablas como: %s.",
    "GX.1.4.3": "El parámetro '%s' en la regla parm debe especificar explícitamente su dirección (In:, Out: o Inout:).",
    "GX.1.5": "Condición booleana compleja detectada (%d operadores lógicos). Se recomienda no exceder los 3 operandos para mantener la legibilidad natural del código.",
    "GX.1.6.1": "Falta un comentario explicativo en la línea superior inmediata antes del llamado a la Subrutina (DO).",
    "GX.1.6.2": "La Subrutina declarada en la línea %d debe contener un comentario descriptivo en su primera línea interna ejecutable.",
    "GX.1.7.1": "Bloque de Historia de Cambios incompleto o ausente en la cabecera/sección Rules del objeto. Falta incluir los tags obligatorios: %s.",
    "GX.1.7.2/empty": "Línea de comentario vacía detectada. Si la fila está comentada, debe incluir una explicación justificativa real.",
    "GX.1.7.2/line": "Uso incorrecto de comentarios como separadores estéticos puros. Las líneas comentadas deben aportar información explicativa sobre el cambio.",
    "GX.2.1": "Mala práctica de rendimiento detectada: Se debe evitar el uso de la cláusula condicional WHEN dentro de las sentencias WHERE (Bloque de la línea %d). Se sugiere resolver la lógica condicional mediante variables previas al For Each.",
    "GX.2.2": "Mala práctica de optimización: Evitar el uso de operadores lógicos o subconsultas (%s) dentro de una misma cláusula WHERE (Bloque de la línea %d). Se deben dividir en múltiples sentencias WHERE secuenciales independientes.",
    "GX.2.3": "Mala práctica de rendimiento: Se ha excedido el límite máximo de 2 niveles de For Each anidados de forma concurrente (Detectado nivel de anidación: %d). Optimice el diseño usando Data Providers, Subrutinas o unificando las consultas.",
    "GX.2.4": "Mala práctica de performance crítica: No se permite el uso de funciones (%s) dentro de las cláusulas WHERE (Bloque de la línea %d). Invalida la optimización de índices en el DBMS. Se sugiere precalcular el valor en una variable antes del For Each.",
    "GX.2.5": "Mala práctica de mantenibilidad: Se detectó un valor en código duro (Hardcoded) '%s' dentro de la cláusula WHERE (Bloque de la línea %d). Se exige parametrizar este valor mediante una variable local antes del For Each.",
    "GX.2.6": "Mala práctica crítica en Subrutina %s: No se detectó ninguna inicialización de variable de salida/control. Se exige por política corporativa inicializar las variables de retorno usando la función 'nullvalue()' en las primeras líneas del bloque.",
    "GX.2.7.1": "Mala práctica de legibilidad crítica: Se detectó el uso de variables sueltas genéricas (%s) dentro de un bloque de iteración (Origen en la línea %d). Modifique el identificador por un nombre descriptivo corporativo.",
    "GX.2.7.2": "Mala práctica de desarrollo: Se detectó el uso de variables sueltas genéricas (%s) actuando como contadores o acumuladores de datos. Modifique el identificador por un nombre descriptivo corporativo (ej: &ItemCount, &RowIndex).",
    "GX.2.7.3": "Mala práctica de control de flujos crítica: Se detectó la reutilización de la variable de condición/estado '%s' en una nueva asignación de contexto. Se exige definir variables con nombres descriptivos únicos por cada escenario de validación (ej: &IsCustomerValid, &ProcessSuccess) para evitar estados remanentes corruptos.",
    "GX.2.7.4": "Mala práctica de optimización: Se detectó que la variable '&%s' es asignada o declarada, pero nunca es leída o consumida en el flujo del objeto. Elimínela para optimizar el consumo de memoria.",
    "GX.2.7.5": "La variable '%s' se asigna y se sobrescribe sin ser leída entre ambas asignaciones.",
    "GX.SEC.1": "Se detectó un valor sensible embebido en '%s' (patrón de credencial, CWE-798). Parametrizar desde configuración segura y rotar el secreto.",
    "GX.SEC.2": "Posible %s (CWE-%d): el valor de '%s' llega a '%s' sin sanitizador modelado.",
}


def routes(ids: list[str] | tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """The flags of each chosen rule that is routed by tokens; one without flags is an error of the catalogue."""
    chosen = [i for i in ids if BY_ID[i].route == "tokens"]
    unmapped = [i for i in chosen if not ROUTES.get(i)]
    if unmapped:
        raise ValueError(f"no flags for the tokens of {', '.join(unmapped)}")
    return {i: ROUTES[i] for i in chosen}


def catalog(spark: SparkSession) -> DataFrame:
    """The 34 descriptors as rows."""
    rows = [(r.id, r.version, r.name, r.severity, r.description, r.category, r.route, r.scope, r.cost, r.abstract, r.default, i) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, version string, name string, severity string, description string, category string, route string, scope string, cost string, is_abstract boolean, is_default boolean, ord int")


def profile(enable: list[str] | None = None, disable: list[str] | None = None) -> list[str]:
    """Concrete rule ids in catalogue order: the default profile, or a whitelist, less what is disabled. An unknown id is an error."""
    unknown = [r for r in [*(enable or ()), *(disable or ())] if r not in BY_ID]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    if enable is not None and len(set(enable)) < len(enable):
        raise ValueError("a rule is named twice")
    chosen = set(DEFAULT if enable is None else enable) - set(disable or ())
    out = [r for r in CONCRETE if r in chosen]
    if not out:
        raise ValueError("no concrete rule is enabled")
    return out
